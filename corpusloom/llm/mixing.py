"""Mixing sources to target weights by Pareto order sampling.

Sources share `share` times all sizes by weight. A source's target is at most `most` times its own size; what is above is
shared again by weight among the others until none is above. Within a source a document is expected as often as its own weight
says: `weight` is an expression over docs, by default 1 for all (`by_length`, which the query and the pipeline use, is the
square root of the size, so that longer documents are repeated more readily than short ones). A document's expected number of
copies is min(most, level * weight), with the one level of its source at which the expected words are the target. The whole part of that number is allocated for certain. What is left of it is the
probability of one more copy: documents are ranked by the odds of a fixed random number u, made from id and text, divided by
the odds of that probability (Pareto order sampling), and taken from the start of that order as long as they fit in what the
certain copies leave of the target. The sample is of fixed size in words, not in documents. Then the document whose size is
closest to what remains is added if that brings the source nearer to its target; what then remains is less than half the
smallest document that was left, or, in a source that is used up but for documents longer than the gap, up to half of these.

Weights are rounded to steps of about one in a hundred, so that a source's level is found exactly from a bounded number of
sums. Sums along the order are taken in two steps, over buckets of the rank and then within a bucket, so that a source that
holds most of the rows is dealt to many tasks; the number of buckets grows with the source. Rows that are equal in id, source
and text are one entry with a count until the end. Ranks come from hashes: reruns agree.

Nulls and ties: a null text has size 0; a null source is a source of its own, last in order; a null id is hashed as such.
Documents of a null or non-positive weight are taken only if their source is taken `most` times as a whole; those of size 0 are
never drawn for one more copy.
Rows equal in id, source and text are interchangeable: the sample takes a number of them. A source whose target needs more
than its documents of positive weight can give takes each of those `most` times and no others. An empty table gives an empty
result; other columns are kept by `mixed` and ignored by `mix_sources`."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 11
#: Steps of a doubling to which weights are rounded, and doublings around 1 that are told apart.
STEPS, DOUBLINGS = 64, 64
#: Rows of a bucket of the order, about.
BUCKET_ROWS = 2048


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def by_length() -> Column:
    """A document's weight: the square root of its size."""
    return F.sqrt(n_words(F.col("text")))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Of (source, source_size): with target. A row for each source; the windows are over sources, not documents.

    With caps reshared until none is above, each target is min(cap, level * weight) for one level: sources are capped in
    the order of cap / weight, and the level shares what the caps leave by the other weights."""
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8")))
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1))
    out = out.withColumns({"cap": most * F.col("source_size"), "total": share * F.sum("source_size").over(every)})
    by_level = every.orderBy(F.col("cap") / F.col("weight"), "rank_")
    out = out.withColumn("rank_", rank)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    capped, open_weight = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level_here", (F.col("total") - capped) / open_weight)
    is_open = F.col("level_here") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(is_open, F.struct("cap_order", "level_here"))).over(every)["level_here"]
    out = out.withColumn("cap_order", F.row_number().over(by_level)).withColumn("level", level)
    return out.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def pareto_rank(u: Column, probability: Column) -> Column:
    """Random odds divided by inclusion odds, as a logarithm: the least are sampled. Null for a probability of 0."""
    return F.when(probability >= 1, F.lit(float("-inf"))).when(probability > 0, F.log(u) - F.log1p(-u) - F.log(probability) + F.log1p(-probability))


def rounded_weight(weight: Column) -> Column:
    """The logarithm of a weight in steps; null for no weight."""
    return F.when(weight > 0, F.greatest(F.lit(-DOUBLINGS * STEPS), F.least(F.lit(DOUBLINGS * STEPS), F.round(F.log2(weight) * STEPS)))).cast("int")


def levels(by_weight: DataFrame, most: float) -> DataFrame:
    """Of rows (source, step, words, target), at most 2 * STEPS * DOUBLINGS + 1 for a source, its level: the expected copies of
    a weight w are min(most, level * w). Null: all are capped."""
    w = F.pow(F.lit(2.0), F.col("step") / STEPS)
    heaviest = Window.partitionBy("source").orderBy(F.desc("step"))
    above, rest = heaviest.rowsBetween(Window.unboundedPreceding, -1), heaviest.rowsBetween(0, Window.unboundedFollowing)
    here = (F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0))) / F.sum(w * F.col("words")).over(rest)
    rows = by_weight.where("step IS NOT NULL AND words > 0").withColumns({"here": here, "w": w})
    # The first step, from the heaviest, that is not capped if all heavier ones are.
    return rows.where(F.col("here") * F.col("w") <= most).groupBy("source").agg(F.max_by("here", "step").alias("level"))


def allotted(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, weight: Column | None = None) -> DataFrame:
    """Of docs (doc_id, text, source, and what `weight` reads) a row for each of (doc_id, source, h: a hash of id and text) with
    size, source_size, target, rows (how many there are), whole (copies that each row gets) and more (how many rows get one
    more)."""
    size = n_words(F.col("text"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("h"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("own"))
    # Texts are read once; what follows reads rows of a few numbers.
    entries = cut(sized.groupBy("doc_id", "source", "size", "h").agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("rows")).withColumn("step", rounded_weight(F.col("own"))).drop("own"))
    words = F.col("size") * F.col("rows")
    by_weight = entries.groupBy("source", "step").agg(F.sum(words).alias("words"), F.sum("rows").alias("rows"))
    by_source = by_weight.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows"))
    plan = targets(by_source.select("source", "source_size"), weights, share, most)
    plan = plan.join(by_source.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    by_weight = by_weight.drop("rows").join(plan.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    level = levels(by_weight, most).withColumnRenamed("source", "s")
    buckets = F.ceil(F.col("rows") / (4 * BUCKET_ROWS))  # for each unit of the rank, around which a quarter of a source lies at most
    plan = cut(plan.join(level, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "level", buckets.alias("buckets")))

    rows = entries.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    full = F.col("target") >= most * F.col("source_size")
    expected = F.when(F.col("source_size") == 0, 0.0).when(full, F.lit(float(most))).when(F.col("step").isNull(), 0.0).otherwise(F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.pow(F.lit(2.0), F.col("step") / STEPS), F.lit(float(most)))))
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + F.lit(1e-9)).cast("long"))
    # u in (0, 1).
    u = (F.pmod(F.xxhash64("h"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    chance = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    rows = cut(rows.withColumn("rank", pareto_rank(u, chance)).withColumn("bucket", F.floor(F.col("rank") * F.col("buckets"))))

    certain = rows.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("whole") * words).alias("certain"))
    order = rows.where("rank IS NOT NULL")
    sums = order.groupBy("source", "bucket").agg(F.sum(words).alias("n"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    sums = sums.join(certain, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "b", (F.col("before") + F.col("certain")).alias("before"))
    order = order.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("target") - F.col("before") - F.coalesce(F.sum(words).over(inside), F.lit(0))
    order = cut(order.select("doc_id", "source", "size", "h", "rows", "rank", "target", "before", F.least("rows", F.greatest(F.lit(0), F.floor(room / F.col("size")))).cast("long").alias("more")))

    # What remains of each source after the order's start, and the entry whose size fits it best.
    took = order.groupBy("source").agg(F.sum(F.col("more") * F.col("size")).alias("took"), F.max("target").alias("target"))
    left = took.join(certain, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), (F.col("target") - F.col("certain") - F.col("took")).alias("gap"))
    rest = order.where("more < rows").join(left, F.col("source").eqNullSafe(F.col("s")))
    closest = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "h", "doc_id", "gap")).alias("x"))
    added = closest.where("x.off < x.gap").select("source", F.col("x.h").alias("h"), F.col("x.doc_id").alias("doc_id"), F.lit(1).cast("long").alias("more"))
    more = order.where("more > 0").select("source", "h", "doc_id", "more").union(added).groupBy("source", "h", "doc_id").agg(F.sum("more").alias("more"))
    more = more.select(F.col("source").alias("s"), F.col("h").alias("h_"), F.col("doc_id").alias("d"), "more")
    out = rows.join(more, (F.col("h") == F.col("h_")) & F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.select("doc_id", "source", "h", "size", "source_size", "target", "rows", "whole", F.coalesce("more", F.lit(0)).alias("more"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """For each document doc_id, size, source_size, target and taken (words that the mix takes, repeats counted)."""
    each = allotted(docs, **options).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    taken = (F.col("whole") + (F.col("nth") <= F.col("more")).cast("long")) * F.col("size")
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, weight: Column | None = None) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken. Of rows equal in id, source and text that are
    not all taken equally often, those first by a hash of all their columns are taken more often."""
    plan = allotted(docs, weights, share, most, seed, weight).where("whole > 0 OR more > 0")
    plan = plan.select(F.col("h").alias("__h"), F.col("source").alias("__s"), F.col("whole").alias("__whole"), F.col("more").alias("__more"), F.col("rows").alias("__rows"))
    own = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    met = lambda plan: docs.withColumn("__own", own).join(plan, (F.col("__h") == F.col("__own")) & F.col("source").eqNullSafe(F.col("__s")))
    # Only entries that are taken in part, two of a source at most, need their rows told apart.
    apart = (F.col("__more") > 0) & (F.col("__more") < F.col("__rows"))
    alike = met(plan.where(~apart)).withColumn("__copies", F.col("__whole") + F.when(F.col("__more") > 0, 1).otherwise(0))
    nth = F.row_number().over(Window.partitionBy("__own", "__s").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    partly = met(plan.where(apart)).withColumn("__copies", F.col("__whole") + F.when(nth <= F.col("__more"), 1).otherwise(0))
    every = alike.unionByName(partly).where("__copies > 0")
    return every.withColumn("__each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long")))).select(docs.columns)
