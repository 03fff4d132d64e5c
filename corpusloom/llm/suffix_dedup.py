"""Byte-level deduplication with sharded suffix arrays.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else, in the same document or another.
Texts are taken as UTF-8; matches never cross documents.

1. Winnowing over bytes: each string of `length` bytes has a least gram by hash. Strings that are equal have the same one, so
   a string can recur only if its least gram occurs twice. Grams are counted by hash, per document first.
2. Documents with recurring grams are cut into pieces: runs of string starts with the same least gram. Every start lies in
   one piece, and equal strings lie in pieces of the same gram, so grams can be dealt to shards. Equal pieces are counted
   before they are dealt; a hot passage is one piece with a count. A gram whose distinct pieces are too many for a shard, such
   as one of a line that unlike documents share, is split: equal strings also agree in the gram's offset and in all bytes
   around it, so its pieces are cut by ranges of that offset and keyed by the bytes that all strings of a range hold. Ranges
   are halved for the keys that are still too large; a range of one offset has one distinct piece for each key.
3. Each shard sorts its pieces' suffixes in two stages (`two_stage_order`): only the suffixes that are smaller than their
   successors are sorted directly; the others are induced from them by scans over first-byte buckets. Common prefixes of
   adjacent suffixes then tell which starts recur.
4. Recurring starts are joined back to where their pieces occur and their strings are removed.

Shards are bounded by bytes of distinct pieces; documents are compared through grams alone, never in pairs.

Nulls and ties: a null text is empty. Ids may be null or repeat; rows are told apart by id and text, and equal rows count as
often as they occur, so that a repeated long row is removed from both. Equal texts are looked at once. An empty table gives an
empty result; other columns are ignored."""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta
from corpusloom.llm.scratch import cut, small_batches

LENGTH = 400
GRAM = 64
#: Bytes of distinct pieces in a shard, about.
SHARD_BYTES = 4 << 20
#: Offsets of a gram in a range, at first, where its pieces are too many.
OFFSETS = 42


def two_stage_order(text: np.ndarray, stops: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The positions of `wanted` (sorted, ascending) in the order of their suffixes, as far as `depth` bytes.

    text: bytes of all pieces one after another; stops[p]: end of the piece that position p lies in. A suffix ends with its
    piece. Suffixes of type B are smaller than their successors and are sorted directly; a suffix of type A is greater
    than its successor and is placed when the scan passes the successor."""
    n = len(text)
    every = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    last = every + 1 >= stops
    following = np.where(last, -1, text[np.minimum(every + 1, n - 1)].astype(np.int16))
    step = np.sign(following - text).astype(np.int8)  # 1: smaller than its successor, by first bytes; 0: look further
    del following
    nearest = np.minimum.accumulate(np.where(step != 0, every, n).astype(every.dtype)[::-1])[::-1]  # the last position of a piece is always decided: its successor is empty
    type_b = step[np.minimum(nearest, n - 1)] > 0
    del nearest, step

    # What the wanted suffixes depend on: the positions after them up to the next one of type B or the piece's end.
    run_end = np.minimum.accumulate(np.where(type_b | last, every, n).astype(every.dtype)[::-1])[::-1]
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, wanted, 1)
    np.add.at(marks, run_end[wanted] + 1, -1)
    need = np.cumsum(marks[:n], dtype=np.int32) > 0
    del marks, run_end

    order_b = _direct(text, stops, np.flatnonzero(need & type_b).astype(every.dtype), depth)
    by_first = [order_b[a:b] for a, b in _cuts(text[order_b])]
    # Type A suffixes that end with their piece after one byte have an empty successor, which sorts before all others.
    seeds = np.flatnonzero(need & ~type_b & last).astype(every.dtype)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    for c, (a, b) in enumerate(_cuts(text[seeds := seeds[np.argsort(text[seeds], kind="stable")]])):
        if b > a:
            waiting[c].append(seeds[a:b])
    induced = need & ~type_b
    starts_piece = np.ones(n, bool)
    starts_piece[1:] = last[:-1]
    # A run of one byte is induced within its own bucket: how far it goes before each position.
    same = induced.copy()
    same[-1:] = False
    same[:-1] &= (text[:-1] == text[1:]) & ~starts_piece[1:]
    broken = np.maximum.accumulate(np.where(same, -1, every).astype(every.dtype))
    del same
    out = []
    for c in range(256):
        fresh = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, every.dtype)
        waiting[c] = []
        done = []
        if len(fresh):
            # All of the bucket's seeds, then what is before each of them, and so on.
            length = np.where(fresh > 0, fresh - broken[np.maximum(fresh - 1, 0)], 1)
            level = np.arange(length.sum(), dtype=every.dtype) - np.repeat((np.cumsum(length) - length).astype(every.dtype), length)
            placed = np.repeat(fresh, length) - level
            done = [placed[np.argsort(level, kind="stable")]]
        bucket = np.concatenate([*done, by_first[c]]) if done or len(by_first[c]) else np.zeros(0, every.dtype)
        out.append(bucket)
        before = bucket[~starts_piece[bucket]] - 1
        before = before[induced[before] & (text[before] > c)]
        if len(before):
            firsts = text[before]
            by = np.argsort(firsts, kind="stable")
            before = before[by]
            for d, (a, b) in enumerate(_cuts(firsts[by])):
                if b > a:
                    waiting[d].append(before[a:b])
    order = np.concatenate(out)
    is_wanted = np.zeros(n, bool)
    is_wanted[wanted] = True
    return order[is_wanted[order]]


def _cuts(ordered: np.ndarray) -> list[tuple[int, int]]:
    at = np.searchsorted(ordered, np.arange(257))
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _direct(text: np.ndarray, stops: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """`which` sorted by up to `depth` bytes: the first eight as numbers, then only what ties. Groups whose suffixes agree in the next
    WIDE bytes need no sorting there, as most do that agree at all; of the others, members are sorted by eight bytes at a time.
    Each step holds a few numbers for each tied suffix, and WIDE bytes of some of them at once."""
    if not len(which):
        return which
    padded = _padded(text)
    keys = _eights(padded, stops, which)
    by = np.argsort(keys, kind="stable")
    out, keys = which[by], keys[by]
    # Places in `out` that tie with a neighbour, and the first place of their group.
    first = np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), np.arange(len(out)), 0))
    del keys, by
    alive = _tied(first)
    first = first[alive]
    shift = 8
    while len(alive) and shift < depth:
        width = min(WIDE, -(-(depth - shift) // 8) * 8)
        split = _differing(padded, stops, out[alive], first, shift, width)
        for step in range(shift, shift + width, 8):
            if not len(split):
                break
            mine, groups = alive[split], first[split]
            keys = _eights(padded, stops, out[mine], step)
            by = np.lexsort((keys, groups))
            out[mine] = out[mine[by]]
            keys = keys[by]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (groups[1:] != groups[:-1])])
            first[split] = np.maximum.accumulate(np.where(new, mine, 0))
            # Members that tie no more leave; groups that are equal from here on are not looked at again in this step.
            split = split[_tied(first[split])]
        still = _tied(first)
        alive, first = alive[still], first[still]
        shift += width
    if len(alive):  # bytes beyond a piece count as zeros: the shorter of two equal ones comes first
        left = np.minimum(stops[out[alive]] - out[alive], depth)
        out[alive] = out[alive[np.lexsort((left, first))]]
    return out


#: Bytes of tied suffixes that are compared at once, and suffixes whose bytes are held for it.
WIDE, HELD = 64, 1 << 17


def _differing(padded: np.ndarray, stops: np.ndarray, at: np.ndarray, first: np.ndarray, shift: int, width: int) -> np.ndarray:
    """Which of the suffixes at `at`, in groups by `first`, are in a group whose next `width` bytes are not all equal."""
    inside = at.astype(np.int64) + (shift + width) <= stops[at]
    unequal = (first[1:] == first[:-1]) & ~(inside[1:] & inside[:-1] & _equal(padded, at[1:], at[:-1], shift, width))
    groups = np.unique(first[1:][unequal])
    if not len(groups):
        return np.zeros(0, np.int64)
    found = np.minimum(np.searchsorted(groups, first), len(groups) - 1)
    return np.flatnonzero(groups[found] == first)


def _tied(first: np.ndarray) -> np.ndarray:
    """The places of groups of two or more."""
    same = np.concatenate([[False], first[1:] == first[:-1], [False]])
    return np.flatnonzero(same[1:] | same[:-1])


def _padded(text: np.ndarray) -> np.ndarray:
    """The text with room for WIDE bytes from any place on."""
    return np.concatenate([text, np.zeros(WIDE, np.uint8)])


def _eights(padded: np.ndarray, stops: np.ndarray, at: np.ndarray, shift: int = 0) -> np.ndarray:
    """The eight bytes from at + shift on as one number, zeros beyond the piece."""
    rows = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    place = at.astype(np.int64) + shift
    out = rows[np.minimum(place, len(padded) - 8)].view(">u8")[:, 0].astype(np.uint64)
    held = np.clip(stops[at] - place, 0, 8)
    short = np.flatnonzero(held < 8)
    bits = ((8 - held[short]) * 8).astype(np.uint64)
    out[short] = np.where(bits == 64, 0, (out[short] >> np.minimum(bits, np.uint64(63))) << np.minimum(bits, np.uint64(63)))
    return out


def _equal(padded: np.ndarray, a: np.ndarray, b: np.ndarray, shift: int, width: int) -> np.ndarray:
    """Which of the places a and b hold the same `width` bytes from shift on; a part of them at a time."""
    rows = np.lib.stride_tricks.as_strided(padded, (len(padded) - width + 1, width), (1, 1))
    out = np.empty(len(a), bool)
    for i in range(0, len(a), HELD):
        x, y = (rows[np.minimum(p[i : i + HELD].astype(np.int64) + shift, len(rows) - 1)] for p in (a, b))
        out[i : i + HELD] = (x.view(np.uint64) == y.view(np.uint64)).all(1) if width % 8 == 0 else (x == y).all(1)
    return out


def recurring(text: np.ndarray, stops: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Which of the wanted starts, each with `length` bytes left in its piece, share those bytes with another."""
    order = two_stage_order(text, stops, wanted, length)
    same = np.zeros(len(order), bool)
    alive = np.arange(len(order) - 1)
    padded, shift = _padded(text), 0
    while len(alive) and shift < length:  # adjacent common prefixes
        width = min(WIDE, length - shift)
        alive = alive[_equal(padded, order[alive], order[alive + 1], shift, width)]
        shift += width
    same[alive] = True
    same[alive + 1] = True
    out = np.zeros(len(text), bool)
    out[order[same]] = True
    return out[wanted]


def _gram_counts(batches, length: int, gram: int):
    """For each document its bytes, digest, and chosen grams with how often each occurs."""
    for batch in batches:
        sizes, digests, grams, counts = [], [], [], []
        for c in ta.chunks(batch.column("text")):
            found, _, chosen = ta.local_minima(c.data.astype(np.uint64) + np.uint64(1), c.bounds, gram, length)
            at = np.flatnonzero(chosen)
            cuts = np.searchsorted(at, c.bounds)
            for i in range(c.size):
                text = c.text(i)
                sizes.append(len(text))
                digests.append(hashlib.sha256(text).hexdigest())
                g, k = np.unique(found[at[cuts[i] : cuts[i + 1]]], return_counts=True)
                grams.append(ta.signed(g))
                counts.append(k)
        if grams:
            lengths = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(digests), pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(grams))), pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(counts).astype(np.int32)))],
                ["doc_id", "h", "n_bytes", "digest", "grams", "counts"],
            )


def _pieces(batches, length: int, gram: int):
    """Runs of starts whose least gram recurs, cut where the least gram changes."""
    for batch in batches:
        digests, hits, copies = batch.column("digest").to_pylist(), batch.column("hits"), batch.column("copies").to_pylist()
        out: list[list] = [[] for _ in PIECES]
        for c in ta.chunks(batch.column("text")):
            _, least, _ = ta.local_minima(c.data.astype(np.uint64) + np.uint64(1), c.bounds, gram, length)
            for i in range(c.size):
                base = int(c.bounds[i])
                mine = least[base : max(base, min(int(c.bounds[i + 1]) - length + 1, len(least)))]
                if not len(mine):
                    continue
                edges = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1], [True]]))
                known = np.isin(mine[edges[:-1]], np.asarray(hits[c.first + i].values).view(np.uint64))
                for r in np.flatnonzero(known).tolist():
                    a, b = int(edges[r]), int(edges[r + 1])
                    piece, g = c.data[base + a : base + b - 1 + length].tobytes(), int(mine[a].view(np.int64))
                    row = (digests[c.first + i], a, b - a, g, g, hashlib.blake2b(piece, digest_size=16).digest(), piece, copies[c.first + i])
                    for x, v in zip(out, row, strict=True):
                        x.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, PIECES.types, strict=True)], PIECES.names)


#: g: the key by which pieces are dealt; gram: the least gram of the piece's starts.
PIECES = pa.schema([("digest", pa.string()), ("at", pa.int64()), ("starts", pa.int32()), ("g", pa.int64()), ("gram", pa.int64()), ("piece_id", pa.binary()), ("piece", pa.binary()), ("copies", pa.int64())])
PIECES_SQL = "digest string, at long, starts int, g long, gram long, piece_id binary, piece binary, copies long"


def _split(batches, length: int, gram: int, offsets: int):
    """Pieces cut where the offset of the next occurrence of their gram leaves a range of `offsets`, each keyed by the bytes that
    all strings of the range hold."""
    for batch in batches:
        out: list[list] = [[] for _ in PIECES]
        for digest, at, starts, _, g, _, piece, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            data = np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)
            where = np.flatnonzero((ta.rolling_hash(data, gram) | np.uint64(1)).view(np.int64) == g)
            p = np.arange(starts)
            q = where[np.searchsorted(where, p)]
            ranges = (q - p) // offsets
            edges = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (ranges[1:] != ranges[:-1]), [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                r, here = int(ranges[a]), int(q[a])
                greatest = min((r + 1) * offsets, length - gram + 1) - 1
                held = piece[here - r * offsets : here - greatest + length]
                key = int.from_bytes(hashlib.blake2b(held, digest_size=8, key=r.to_bytes(4, "little")).digest(), "little", signed=True)
                part = piece[a : b - 1 + length]
                for x, v in zip(out, (digest, at + a, b - a, key, g, hashlib.blake2b(part, digest_size=16).digest(), part, copies), strict=True):
                    x.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, PIECES.types, strict=True)], PIECES.names)


def _dealt(pieces: DataFrame, length: int, gram: int, shard_bytes: int) -> list[DataFrame]:
    """The pieces in tables whose keys have no more distinct bytes than a shard takes, or one piece."""
    done, offsets = [], OFFSETS
    while True:
        each = pieces.groupBy("g", "piece_id").agg(F.max(F.octet_length("piece")).alias("size"))
        hot = each.groupBy("g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") > shard_bytes) & (F.col("n") > 1)).select("g")
        if not offsets or (hot := cut(hot)).isEmpty():
            return [*done, pieces]
        done.append(pieces.join(hot, "g", "left_anti"))
        pieces = cut(pieces.join(hot, "g", "left_semi").select(*PIECES.names).mapInArrow(ta.released(_split, length=length, gram=gram, offsets=offsets), PIECES_SQL))
        offsets = 0 if offsets == 1 else -(-offsets // 2)


FOUND = pa.schema([("g", pa.int64()), ("piece_id", pa.binary()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))])


def _shard(table: pa.Table, length: int) -> pa.Table:
    """One shard's pieces: the runs [first, last) of starts that recur."""
    pieces, starts, counts = table.column("piece").to_pylist(), table.column("starts").to_numpy(), table.column("n").to_numpy()
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    text, stops = np.frombuffer(b"".join(pieces), np.uint8), np.repeat(ends, sizes)
    owner = np.repeat(np.arange(len(pieces)), starts)
    begin = np.concatenate([[0], np.cumsum(starts)])
    wanted = (ends - sizes)[owner] + np.arange(len(owner)) - begin[:-1][owner]
    flags = recurring(text, stops, wanted, length) | (counts > 1)[owner]
    rows: list[list] = [[] for _ in range(4)]
    ids, grams = table.column("piece_id").to_pylist(), table.column("g").to_pylist()
    for p in np.flatnonzero(np.add.reduceat(flags, begin[:-1])).tolist() if len(owner) else []:
        edges = np.diff(np.concatenate([[0], flags[begin[p] : begin[p + 1]].astype(np.int8), [0]]))
        for x, v in zip(rows, (grams[p], ids[p], np.flatnonzero(edges == 1).astype(np.int32), np.flatnonzero(edges == -1).astype(np.int32)), strict=True):
            x.append(v)
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(rows, FOUND.types, strict=True)], schema=FOUND)


def _removed(batches, length: int, with_bytes: bool):
    """Texts without the strings that start in the given runs."""
    for batch in batches:
        rows: list[list] = [[] for _ in range(4 + with_bytes)]
        for text, digest, runs in zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            data = text.encode()
            marks = np.zeros(len(data) + 1, np.int32)
            for r in runs:
                marks[r["a"]] += 1
                marks[r["b"] - 1 + length] -= 1
            gone = np.cumsum(marks[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
            for x, v in zip(rows, (digest, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                x.append(v)
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=False)], ["digest", "n_removed", "n_spans", "kept_sha256", "kept"][: len(rows)])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For each document doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept_sha256, and if asked for `kept`,
    the remaining bytes (null where nothing was removed)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    summary = cut(texts.mapInArrow(ta.released(_gram_counts, length=length, gram=gram), "doc_id long, h long, n_bytes long, digest string, grams array<long>, counts array<int>"))
    # Equal texts are looked at once, as a row with the least id, with their number; `same` rows have that id and text.
    found = F.arrays_zip("grams", "counts")
    classes = summary.where(F.col("n_bytes") >= length).groupBy("digest", "doc_id", "h").agg(F.count(F.lit(1)).alias("same"), F.any_value(found).alias("found"))
    classes = cut(classes.groupBy("digest").agg(F.min(F.struct("doc_id", "h", "same")).alias("x"), F.sum("same").alias("copies"), F.any_value("found").alias("found")))
    grams = classes.select("digest", "copies", F.inline("found").alias("g", "n"))
    shared = grams.groupBy("g").agg(F.sum(F.col("n") * F.col("copies")).alias("n")).where("n > 1").select("g")
    hits = grams.join(shared, "g").groupBy("digest").agg(F.collect_set("g").alias("hits")).join(classes.select("digest", "x.doc_id", "x.h", "x.same", "copies"), "digest")
    # Rows that share an id are told apart by their texts' hashes; ids may be null.
    keyed = texts.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "text")
    met = keyed.join(hits, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("h"))).where(F.sha2("text", 256) == F.col("digest"))
    met = met.select("digest", "text", "hits", "copies", "same")
    candidates = cut(met.where("same = 1").union(met.where("same > 1").dropDuplicates(["digest"])).drop("same"))
    pieces = cut(candidates.mapInArrow(ta.released(_pieces, length=length, gram=gram), PIECES_SQL))
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    shards = max(8, -(-size // shard_bytes))
    pieces = reduce(DataFrame.unionByName, _dealt(pieces, length, gram, shard_bytes))
    distinct = pieces.groupBy("g", "piece_id").agg(F.first("piece").alias("piece"), F.first("starts").alias("starts"), F.sum("copies").alias("n"))
    found = distinct.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards))).groupBy("shard")
    found = found.applyInArrow(lambda t: _shard(t, length), "g long, piece_id binary, first array<int>, last array<int>")
    runs = pieces.select("digest", "at", "g", "piece_id").join(found, ["g", "piece_id"])
    runs = runs.select("digest", "at", F.inline(F.arrays_zip("first", "last"))).groupBy("digest").agg(F.collect_list(F.struct((F.col("at") + F.col("first")).alias("a"), (F.col("at") + F.col("last")).alias("b"))).alias("runs"))
    kinds = "digest string, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    removed = candidates.select("digest", "text").join(runs, "digest").mapInArrow(ta.released(_removed, length=length, with_bytes=with_bytes), kinds)
    out = summary.drop("grams", "counts", "h").join(removed, "digest", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"), *(["kept"] if with_bytes else []))
