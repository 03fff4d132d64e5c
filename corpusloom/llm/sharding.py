"""Sharding by a two-pass external shuffle.

First pass: a seeded hash scatters the rows uniformly into buckets that fit in memory. Second pass: each bucket, ordered by
a second hash so that its start does not depend on how rows arrived, is shuffled (Spark's `shuffle`, a Fisher-Yates
shuffle, with a seed). Buckets one after another are a random permutation of all rows. The row at position p goes to shard
p mod `shards`, slot p div `shards`, so shards' counts are at most one apart (law `rows`) and slots have no gaps.

A bucket's content is gathered as one array of its rows' keys, whose number is bounded by BUCKET_ROWS: hashes deal rows evenly,
whatever their texts or sources, and rows that are equal in id and text are counted and numbered first, so that each has a hash of
its own. Only the buckets' counts are summed across buckets. `write_shards` moves whole rows: they are scattered by bucket, joined to their places
there, and written by shard in slot order; it numbers equal rows within a window, which may spill.

Nulls and ties: a null text has size 1 and the CRC of no bytes (0). Equal rows are interchangeable: a number of places is theirs.
The law `rows` makes no use of groups, so equal texts may come into several shards. Null ids are hashed as such. An empty table
gives an empty result; other columns are ignored by `shard` and kept by `write_shards`."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
SEED = 23
BUCKET_ROWS = 4096


def _scattered(rows: DataFrame, total: int, seed: int) -> tuple[DataFrame, int]:
    """rows (doc_id, size, text_crc32, h, n) with their bucket."""
    buckets = max(1, -(-total // BUCKET_ROWS))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "h", "n"), F.lit(buckets)).cast("int")), buckets


def places(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """For each row doc_id, size, text_crc32, h (hash of id and text), n (which of the rows of that hash), shard and slot."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("h"))
    # Equal rows get numbers, and so hashes of their own.
    rows = rows.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("doc_id", "size", "text_crc32", "h", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("n")).withColumn("o", F.xxhash64(F.lit(seed + 1), "h", "n"))
    rows, buckets = _scattered(rows, docs.count(), seed)
    # As many partitions as buckets would be many small ones; a fixed number of them keeps the seeds of the shuffle fixed.
    parts = max(1, min(buckets, 4096))
    rows = rows.repartition(parts, "bucket")
    packed = rows.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("o", "doc_id", "size", "text_crc32", "h", "n"))).alias("rows"))
    packed = packed.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed).alias("rows"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = packed.join(starts, "bucket").select("start", F.posexplode("rows").alias("at", "row"))
    p = F.col("start") + F.col("at")
    return placed.select("row.doc_id", "row.size", "row.text_crc32", "row.h", F.pmod(p, F.lit(shards)).cast("int").alias("shard"), F.floor(p / F.lit(shards)).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """For each document doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is `rows`)."""
    return places(docs, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the documents as Parquet, a folder for each shard (shard=0, ...), in slot order within each file."""
    at = places(docs, shards, seed).select("h", "shard", "slot")
    at = at.withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("shard", "slot")))
    rows = docs.withColumn("__h", F.xxhash64(F.col("doc_id"), "text"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__h").orderBy("__h")))
    out = rows.join(at, (F.col("__h") == F.col("h")) & (F.col("__n") == F.col("nth"))).select(*docs.columns, F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    out = out.repartition("__shard", F.floor(F.col("__slot") / 100_000)).sortWithinPartitions("__shard", "__slot")
    out.withColumnRenamed("__shard", "shard").withColumnRenamed("__slot", "slot").write.partitionBy("shard").parquet(path)
