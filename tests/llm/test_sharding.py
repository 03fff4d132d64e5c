import zlib
from collections import Counter, defaultdict

from tests.llm.cases import SCHEMA, documents

from corpusloom.llm import sharding
from corpusloom.llm.sharding import shard, write_shards


def test_places(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    rows = documents()
    rows += [rows[1], rows[1], (None, None, None, None, None, 1, "k")]
    got = shard(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shard(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_order_is_random(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 500)
    rows = [(i, f"text {i}", "en", "s", 1, 1, "k") for i in range(4000)]
    got = {r.doc_id: r.slot * 8 + r.shard for r in shard(spark.createDataFrame(rows, SCHEMA)).collect()}
    moves = [got[i] for i in range(4000)]
    assert sorted(moves) == list(range(4000))
    rising = sum(a < b for a, b in zip(moves, moves[1:], strict=False)) / 3999
    assert 0.46 < rising < 0.54
    assert abs(sum(moves[:1000]) / 1000 - 2000) < 150


def test_written_shards(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {r.doc_id: (r.shard, r.slot) for r in shard(docs).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in back.collect()} == want
    assert Counter(tuple(r) for r in back.select(docs.columns).collect()) == Counter(rows)


def test_empty_table(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_rows_are_dealt_to_many_buckets(spark, monkeypatch):
    """A third of the rows are equal; no bucket holds much more than its share, and slots have no gaps."""
    from pyspark.sql import functions as F

    from corpusloom.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = [(7, "the same", "en", "s", 1, 1, "k")] * 500 + [(None, None, "en", "s", 1, 1, "k")] * 20 + [(i, f"text {i}", "en", "s", 1, 1, "k") for i in range(980)]
    docs = spark.createDataFrame(rows, SCHEMA)
    numbered = docs.select(F.xxhash64("doc_id", "text").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).select("h", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("n"))
    dealt, buckets = sharding._scattered(numbered, len(rows), 23)
    assert buckets == 30 and max(r["count"] for r in dealt.groupBy("bucket").count().collect()) < 100
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    for k in range(8):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots))) and len(slots) in (187, 188)
    assert len({r.shard for r in got if r.doc_id == 7}) == 8
