"""Vector codes: each vector's parts are written as the nearest entries of codebooks, fitted by rounds over all vectors.

Vectors are rows of 32- or 64-bit floats; a component x stands for the integer floor(SCALE * x). `blocks` writes them as columns, one
block for each batch that a task reads, once and in the folder that the cluster shares, so that a lost executor costs its running tasks.
A round is an RDD treeAggregate over the blocks: in each block and part, squared distances to the entries accumulate dimension by
dimension in one array, np.add.at adds the parts into tensors of sums and counts of 64-bit integers, and tensors merge through
a reduction tree. What moves is a tensor for each task, as large as the codebooks, whatever the number of vectors. The driver
divides the last one and broadcasts the new codebooks. All of it is exact: the order of additions makes no difference.

Nulls and ties: a vector that is null, holds a null or a component that isn't finite, or has another length than the one of the least
vec_id that is kept, is dropped. Null vec_ids come after all others; repeated rows count as often as they stand. A distance that
two entries share goes to the lower index. With fewer kept vectors than entries, codebooks have that many. A length that parts don't
divide is cut at floor(length * part / parts). Components beyond 2**26 are calculated as Python's integers; errors
stop at the largest long. Null labels are one group. An empty table gives an empty result; other columns are ignored."""

import hashlib
import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import cut, small_batches

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components that are smaller than this can't overflow a sum of squares of 64-bit integers.
SAFE = 1 << 26
MOST = (1 << 63) - 1
#: Tasks from which the reduction tree has another level.
WIDE = 1000


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 64-bit integers or, if they could be too large, as Python's."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() * SCALE < SAFE:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.ravel().tolist()], object).reshape(x.shape)


def _kept(column: pa.ListArray, size: int) -> np.ndarray:
    """Which vectors of a column have that many finite components."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    good = lengths == size
    flat = column.flatten()
    finite = np.isfinite(np.asarray(flat.fill_null(float("nan"))))
    stops = np.cumsum(np.maximum(lengths, 0))
    bad = np.concatenate([[0], np.cumsum(~finite)])
    return good & (bad[stops] == bad[stops - np.maximum(lengths, 0)])


def _blocks(batches, size: int):
    for batch in batches:
        column = batch.column("embedding")
        rows = np.flatnonzero(_kept(column, size))
        if len(rows):
            flat = np.asarray(column.take(pa.array(rows)).flatten())
            data = np.ascontiguousarray(flat.reshape(len(rows), size).T).tobytes()
            listed = [pa.array([batch.column(c).take(pa.array(rows)).to_pylist()], pa.list_(batch.schema.field(c).type)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*listed, pa.array([data], pa.binary())], ["vec_ids", "labels", "data"])


def finite(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is whole."""
    return vectors.where(F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


@dataclass
class Codebooks:
    """entries[p][k]: entry k of part p, a row of integers; bounds[p]: where part p begins."""

    bounds: list[int]
    entries: list[np.ndarray]

    def columns(self, data: bytes, n: int, kind: str) -> np.ndarray:
        return integers(np.frombuffer(data, kind).reshape(self.bounds[-1], n))

    def nearest(self, columns: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each vector's part, and its squared distance."""
        entries, block = self.entries[part], columns[self.bounds[part] : self.bounds[part + 1]]
        kind = object if object in (entries.dtype, block.dtype) else np.int64
        distance = np.zeros((len(entries), columns.shape[1]), kind)
        for j, column in enumerate(block):
            step = column[None, :] - entries[:, j, None]
            distance += step * step
        codes = distance.argmin(axis=0)
        return codes, distance[codes, np.arange(len(codes))]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def add_block(sums, row, held, kind: str):
    """Add a block's parts to the sums and counts of the entries that they are nearest to."""
    books = held.value
    columns = books.columns(row.data, row.n, kind)
    large = object in (columns.dtype, *(e.dtype for e in books.entries))
    if sums is None:
        sums = [(np.zeros(e.shape, np.int64), np.zeros(len(e), np.int64)) for e in books.entries]
    for p, (total, count) in enumerate(sums):
        codes, _ = books.nearest(columns, p)
        if large and total.dtype != object:
            total = total.astype(object)
            sums[p] = total, count
        np.add.at(count, codes, 1)
        for j, column in enumerate(columns[books.bounds[p] : books.bounds[p + 1]]):
            np.add.at(total[:, j], codes, column)
    return sums


def merge(a, b):
    return a if b is None else b if a is None else [(x + y, m + n) for (x, m), (y, n) in zip(a, b, strict=True)]


def moved(entries: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' mean; those without parts stay."""
    return np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], entries)


def _coded(batches, held, kind: str):
    books = held.value
    for batch in batches:
        for vec_ids, labels, data in zip(*(batch.column(k) for k in range(3)), strict=True):
            columns = books.columns(data.as_py(), len(vec_ids.values), kind)
            found = [books.nearest(columns, p) for p in range(len(books.entries))]
            codes = ["".join(f"{c:02x}" for c in row) for row in zip(*(c.tolist() for c, _ in found), strict=True)]
            errors = [min(MOST, sum(row)) for row in zip(*(d.tolist() for _, d in found), strict=True)]
            yield pa.RecordBatch.from_arrays([vec_ids.values, labels.values, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])


def fitted(blocks: DataFrame, books: Codebooks, kind: str, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after rounds of assigning every part and moving the entries."""
    spark, rows = blocks.sparkSession, blocks.select("data", F.size("vec_ids").alias("n")).rdd
    depth = 2 if rows.getNumPartitions() < WIDE else 3
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)
        sums = rows.treeAggregate(None, partial(add_block, held=held, kind=kind), merge, depth)
        books = Codebooks(books.bounds, [moved(e, *s) for e, s in zip(books.entries, sums, strict=True)])
        held.unpersist()
    return books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """For each kept vector vec_id, code, error, label_error and codebooks_sha256."""
    spark = vectors.sparkSession
    small_batches(spark)
    label = vectors.schema["label"].dataType.simpleString()
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    least = finite(rows).orderBy(*order).select(F.size("embedding").alias("n")).first()
    size = least.n if least else 0
    first = finite(rows).where(F.size("embedding") == size).orderBy(*order).select("embedding").limit(entries).collect()
    seeds = integers(np.array([r.embedding for r in first], kind).reshape(len(first), size))
    bounds = [size * p // parts for p in range(parts + 1)]
    books = Codebooks(bounds, [seeds[:, a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
    blocks = cut(rows.mapInArrow(partial(_blocks, size=size), f"vec_ids array<bigint>, labels array<{label}>, data binary"))
    if first:
        books = fitted(blocks, books, kind, rounds)
    held = spark.sparkContext.broadcast(books)
    coded = cut(blocks.mapInArrow(partial(_coded, held=held, kind=kind), f"vec_id long, label {label}, code string, error long"))
    whole = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    by_label = whole.select(F.col("label").alias("__label"), F.least("label_error", F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
