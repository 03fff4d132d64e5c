import pytest
from pyspark.sql import functions as F

from corpusloom.operators import canons, desk
from corpusloom.sources import builders


def test_empty_and_null_sources(spark):
    docs = spark.createDataFrame([("a", None), ("b", "")], "source string, text string")
    assert builders.titled_verses(docs).count() == 0
    assert builders.numbered_rows(docs).count() == 0
    assert builders.chapters(docs).count() == 0
    assert builders.manifest_lines(docs).count() == 0
    assert builders.marked_verses(spark.createDataFrame([], "source string, page long, text string"), ["Genesis"]).count() == 0


def test_whole_manifests(spark):
    pytest.importorskip("yaml")
    rows = spark.createDataFrame([(1, "a: 1\nb: [x, 'y']\nc:\n  d: 2026-01-02\n"), (2, ""), (3, "a: [1"), (4, None)], "i int, t string")
    got = {r.i: r.j for r in rows.select("i", builders.parsed_yaml(rows.t).alias("j")).collect()}
    assert got == {1: '{"a": 1, "b": ["x", "y"], "c": {"d": "2026-01-02"}}', 2: "{}", 3: None, 4: None}


@pytest.mark.parametrize(
    "quote,canon,want",
    [("He said [They] go", "he said we go now", (True, "1 in order")), ("he said ... now", "he said we go now", (True, "2 in order")), ("now … he said", "he said we go now", (False, "not found")), ("", "x", (True, "0 in order")), (None, None, (True, "0 in order")), ("We go", "we go", (True, "whole"))],
)
def test_matches(spark, quote, canon, want):
    row = spark.createDataFrame([(quote, canon)], "q string, c string").select(canons.match(F.col("q"), F.col("c")).alias("x")).first().x
    assert (row.ok, row.detail) == want


def test_loci_of_nothing(spark):
    canon = canons.Canon("x", prefixes=["X"], separator=".", depth=2)
    assert canons.loci(spark.createDataFrame([(1, None), (2, "")], "id long, text string"), canon, "id").count() == 0


def test_rewrapped_links_stay_whole(spark):
    text = "one two [a link of words](https://x.org/a b) three four"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(desk.rewrapped(F.col("t"), 20).alias("w")).collect()
    assert got[0].w == "one two\n[a link of words](https://x.org/a b)\nthree four" and got[1].w is None
