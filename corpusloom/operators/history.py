"""SC21: the revisions of texts as validity intervals: in which revisions, one after another, a row had a digest.

A revision that changes three rows of a thousand adds three intervals, not a thousand rows, and a live row meets all revisions by
one equal join on its place and digest. How many rows of each revision a live copy matches is a running sum over the ends of
the intervals that its rows have met.

Revisions of a key are numbered by age, 0 the newest, without gaps. Null digests equal nothing; a key without revisions has no
answer; of revisions of one age the copies count as they stand."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import markdown as md

#: What a revision counts for that matches in all rows: more than any number of rows.
EXACT = 10_000


def rendered_rows(revisions: DataFrame, key: str) -> DataFrame:
    """(key, rev, age, rows, marks) of texts (key, rev, age, text): the digests of what readers see, body and then notes in order; marks are
    the digests of the rendered form."""
    named = revisions.withColumn("__k", F.struct(key, "rev", "age"))
    parts = md.rendered(named.select("__k", "text"), "__k").select("__k", F.struct("part", "idx", "h", F.substring(F.sha2("html", 256), 1, 16).alias("m")).alias("x"))
    listed = parts.groupBy("__k").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select("__k.*", F.col("x.h").alias("rows"), F.col("x.m").alias("marks"))


def _placed(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, kind, at, h): rows and marks by their places."""
    of = lambda column, kind: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), h.alias("h")))
    return rows.select(*keep, F.inline(F.concat(of(F.col("rows"), "row"), of(F.col("marks"), "mark"))))


def intervals(revisions: DataFrame, key: str) -> DataFrame:
    """(key, kind, at, h, since, until): the ages, newest first, between which the row or mark at a place had a digest."""
    run = F.col("age") - F.row_number().over(Window.partitionBy(key, "kind", "at", "h").orderBy("age"))
    placed = _placed(revisions, key, "age").where("h IS NOT NULL").distinct().withColumn("__run", run)
    return placed.groupBy(key, "kind", "at", "h", "__run").agg(F.min("age").alias("since"), F.max("age").alias("until")).drop("__run")


def sizes(revisions: DataFrame, key: str) -> DataFrame:
    """(key, rev, age, n, n_marks): a row for each revision."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return revisions.select(key, "rev", "age", F.greatest(size("rows"), F.lit(0)).alias("n"), F.greatest(size("marks"), F.lit(0)).alias("n_marks"))


def matching(history: DataFrame, heads: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """FZ11, AG11 over intervals and sizes: (key, rev, matched, score) of live copies (key, rows, marks): the revision that the copy still
    matches. Rows equal at their place count one each, EXACT more if all do and none is left over, and marks break ties; of
    equal scores the newest wins. A copy without marks is compared by its rows alone."""
    met = _placed(live, key).join(history, [key, "kind", "at", "h"])
    edge = lambda age, n: F.struct(age.alias("age"), F.lit(n).alias("n"))
    ends = met.select(key, "kind", F.explode(F.array(edge(F.col("since"), 1), edge(F.col("until") + 1, -1))).alias("x"))
    sums = ends.groupBy(key, F.col("x.age").alias("age")).agg(*(F.sum(F.when(F.col("kind") == kind, F.col("x.n")).otherwise(0)).alias(kind) for kind in ("row", "mark")))
    line = heads.join(live.select(key), key, "left_semi").withColumn("__head", F.lit(True)).unionByName(sums, allowMissingColumns=True)
    # Ends of an age come before its revisions.
    past = Window.partitionBy(key).orderBy("age", F.coalesce("__head", F.lit(False))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    counted = line.withColumns({"matched": running("row").cast("int"), "marked": running("mark")}).where("__head")
    own = live.select(key, F.size("rows").alias("__n"), F.col("marks").isNotNull().alias("__marked"))
    rows = counted.join(own, key)
    exact: Column = (F.col("n") == F.col("__n")) & (F.col("matched") == F.col("n"))
    bonus = F.when(F.col("__marked") & (F.col("n_marks") > 0), F.col("marked") / F.col("n_marks")).otherwise(0.0)
    rows = rows.withColumn("score", F.col("matched") + F.when(exact, EXACT).otherwise(0) + bonus)
    return rows.groupBy(key).agg(F.max_by(F.struct("rev", "matched", "score"), F.struct("score", -F.col("age"))).alias("x")).select(key, "x.*")
