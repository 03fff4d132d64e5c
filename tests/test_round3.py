"""Findings of round 3."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import checks, gates, markdown, quotes
from corpusloom.plans import desk
from corpusloom.sources import builders


def test_spans_of_a_long_text_in_linear_time(spark):
    """20,000 spans; each was compared with all, which were found anew each time."""
    text = " ".join(f"*span number {i % 10_000} of it*" for i in range(20_000)) + ' "SPAN number 3, of it" *?!?!?!?!?!?!?!*'
    spans = spark.createDataFrame([(text,)], "t string").select(markdown.locus_spans(F.col("t")).alias("s")).first().s
    assert spans == [f"span number {i} of it" for i in range(10_000)]


def test_longest_runs(spark):
    """runs are found in the pair's row."""
    rows = [("a b c d e", "x b c d y a b"), ("a b c d", "xa bx c"), ("a b", ""), ("of the of the way", "of the way of the of")]
    out = spark.createDataFrame(rows, "w string, s string").select(quotes.longest_run(F.split("w", " "), F.col("s")).alias("r")).collect()
    assert [(r.r.run, r.r.start) for r in out] == [(3, 1), (2, 0), (0, 0), (3, 0)]


def test_longest_runs_as_by_trying_all(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("a b ab ba".split(), k=6)), " ".join(rng.choices("a b ab ba".split(), k=12))) for _ in range(200)]

    def want(w, s):
        w = w.split(" ")
        return max(((n, -i) for i in range(len(w)) for n in range(1, len(w) - i + 1) if " ".join(w[i : i + n]) in s), default=(0, 0))

    out = spark.createDataFrame(rows, "w string, s string").select("w", "s", quotes.longest_run(F.split("w", " "), F.col("s")).alias("r")).collect()
    assert all((r.r.run, -r.r.start) == want(r.w, r.s) for r in out)


def test_pairs_of_a_name_only(spark):
    """a span meets the streams of its name that share something with it, not all of them."""
    words = lambda i: " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(12))
    streams = spark.createDataFrame([(str(i), "x" if i < 5 else "y", words(i)) for i in range(10)], "source string, name string, stream string")
    spans = spark.createDataFrame([("1", words(1), "x"), ("2", words(7), "x")], "span_id string, span string, name string")
    assert [(r.span_id, r.source) for r in quotes.candidates(spans, streams, "source", ("name",)).collect()] == [("1", "1")]


def test_digests_of_other_files(spark, tmp_path):
    """a file whose digest begins with 0123 is no match of a row that records another one."""
    import hashlib

    text = next(t for t in map(str, range(1 << 20)) if hashlib.sha256(t.encode()).hexdigest().startswith("0123"))
    spark.createDataFrame([(2, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert desk.held_states(spark, str(tmp_path)).first().state == "mismatch"


def test_a_share_is_a_decimal(spark):
    """49 of 140 words are not more than 0.35 of them."""
    text = lambda n: " ".join(["of"] * n + ["word"] * (140 - n))
    out = spark.createDataFrame([(text(49),), (text(50),)], "s string").select(checks.garbled(F.col("s")).alias("g")).collect()
    assert [r.g for r in out] == [False, True]


def test_names_as_recorded(spark):
    """a name that is recorded with blanks at its ends."""
    claims = spark.createDataFrame([("a", "  t"), ("b", "t: s")], "slug string, title string")
    pieces = spark.createDataFrame([("a", " t", None), ("b", "t", "s")], "slug string, title string, subtitle string")
    assert [r.slug for r in gates.title_disagreements(claims, pieces, as_recorded=True).collect()] == ["a"]
    assert gates.title_disagreements(claims, pieces).count() == 0


def test_verses_without_text(spark):
    """a verse without text at a section's end is not text of the verse before."""
    text = "A\nB\nA\n1:1 one\n2:2 \nB\n3:3 \nB\n4:1 two\n5:2 "
    out = builders.titled_verses(spark.createDataFrame([("s", text)], "source string, text string")).orderBy("ord")
    assert [(r.ord, r.section, r.chapter, r.text) for r in out.collect()] == [(1, "A", 1, "one"), (3, "B", 4, "two")]
