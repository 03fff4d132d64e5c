"""N-gram Jaccard join: size-banded tiles, hashed bitmaps that bound overlaps, exact intersection of sorted arrays.

A document's set holds its distinct shingles of `n` words (fewer words: the whole sequence as one), lower-cased in A-Z. Two
documents link if the Jaccard similarity of their sets is at least `percent` hundredths. The join is exact, for every pair:

1. Documents with equal sets form a class; from here on only classes are compared. Each class gives the prefix of its set
   in one order of all shingles: linked sets share a shingle of their prefixes. The order is by hash, but with shingles that
   are frequent in a sample of documents last, so that passages which many documents share stay out of most prefixes. The
   sample changes the order, never the result.
2. Classes that share a prefix shingle are candidates. In a small group all pairs of fitting sizes are taken; in a large one
   each member is paired with the group's least class. Pairs that share too few prefix shingles to link are left out.
3. Candidates' bitmaps are compared first. A bitmap holds the parity of the hashed shingles, so two bitmaps differ in no
   more bits than the sets in shingles, which bounds the overlap from above. Only pairs that pass are dealt to tiles, one
   class against others of a band of sizes, where sorted arrays are intersected.
4. In large groups, members of other components are compared with a few more members each, and then all that are still in
   different components with each other by size-banded blocks of bitmaps; what passes is decided by intersection again.
   Members of one component need no further link.

A group of near copies thus costs its size, not its square, and only the hashes of prefixes, class keys, bitmaps and links
move; texts move once, and sets only for pairs whose bitmaps allow a link. Shingles that are very frequent in the sample are
large groups from the start: their postings never meet in one task. The frequent shingles are a list of at most `frequent`
hashes.

jaccard_links() returns links that connect all that is similar, not all links: members of a large group that are in one
component already are not compared again.

Nulls and ties: a document without words (null, empty, blank) has an empty set, links with nothing and is its own component.
A null id takes no part: it is its own component (null). Rows with equal ids are one document for components. An empty table
gives an empty result; other columns are ignored."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta
from corpusloom.llm.components import components
from corpusloom.llm.scratch import cut, small_batches

SHINGLE = 5
PERCENT = 75
#: Documents in this many are sampled for the order of shingles, and hashes kept of those found thrice.
SAMPLE_OF = 8
FREQUENT = 1 << 20
#: Groups up to this size are paired in full at once.
SMALL = 32
#: Members of a large group that the others are compared with before all that are still apart are.
LEADERS = 8
#: Shingles found so often in the sample are large groups from the start.
HOT = 64
#: Groups of a member that are known when pairs are dealt to groups.
MEETINGS = 16
#: Members of a tile, and postings of a partition, about.
TILE = 1024
POSTINGS = 1 << 19


def shingle_sets(c: ta.Chunk, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    hashes, bounds = c.words(lower=True)
    grams = ta.rolling_hash(hashes, n)
    out = []
    for i in range(c.size):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = hashes[a:b] + np.uint64(b - a)
            out.append(ta.mix(ta.prefix_sums(whole)[-1:] + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _frequent_in_sample(batches, n: int):
    for batch in batches:
        sets = [s for c in ta.chunks(batch.column("text")) for s in shingle_sets(c, n)]
        if sets:
            found, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ta.signed(found)), pa.array(counts)], ["s", "n"])


def _prefixes(batches, n: int, percent: int, frequent):
    """For each document its set's size, its class key, and, once for each class and task, the prefix (shingles of large
    groups apart from the others) and the bitmap."""
    hot, rank = frequent.value
    seen: set[int] = set()
    for batch in batches:
        sizes, keys, prefixes, crowded, maps = [], [], [], [], []
        known = batch.column("doc_id").is_valid().to_pylist()
        for c in ta.chunks(batch.column("text")):
            for i, s in enumerate(shingle_sets(c, n), c.first):
                size = len(s)
                key = class_key(s)
                sizes.append(size)
                keys.append(key)
                if not size or not known[i] or key in seen:
                    prefixes.append(None)
                    crowded.append(None)
                    maps.append(None)
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(key)
                maps.append(bitmap(s, bitmap_bits(size)).tobytes())
                wanted = prefix_length(size, percent)
                crowd = s[:0]
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    is_hot = hot[at] == s
                    cold = s[~is_hot]
                    if len(cold) < wanted:
                        by = np.argsort(rank[at[is_hot]], kind="stable")[: wanted - len(cold)]
                        warm, often = s[is_hot][by], rank[at[is_hot]][by]
                        crowd = warm[often >= HOT]
                        s = np.concatenate([cold, warm[often < HOT]])
                    else:
                        s = cold
                prefixes.append(ta.signed(s[:wanted]))
                crowded.append(ta.signed(crowd))
        arrays = [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(crowded, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "size", "c", "prefix", "crowd", "bits"])


def _groups(batches):
    """A partition's postings as arrays sorted by shingle, size and class, without repeats, and the groups' edges."""
    got = pa.Table.from_batches(list(batches))
    s, c, size = (got.column(x).to_numpy() for x in ("s", "c", "size"))
    by = np.lexsort((c, size, s))
    s, c, size = s[by], c[by], size[by]
    if len(s):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (size[1:] != size[:-1])
        s, c, size = s[new], c[new], size[new]
    return s, c, size, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.zeros(1, int)


FIRST = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size_a", pa.int32()), ("size_b", pa.int32()), ("n", pa.int64()), ("s", pa.int64())])
FIRST_SQL = "a long, b long, size_a int, size_b int, n long, s long"


def _unique_pairs(*columns: list[np.ndarray]) -> list[np.ndarray]:
    """Of columns a, b and, if given, their sizes: each pair once, the lesser class first, and how often it was there."""
    a, b, *sizes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in columns)
    turn = a > b
    a, b = np.where(turn, b, a), np.where(turn, a, b)
    if sizes:
        sizes = [np.where(turn, sizes[1], sizes[0]), np.where(turn, sizes[0], sizes[1])]
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return [a[new], b[new], *(x[by][new] for x in sizes), np.diff(np.flatnonzero(np.concatenate([new, [True]])))]


def _first_pairs(batches, percent: int, small: int):
    """All fitting pairs of small groups with how many prefix shingles they share there; in a large group its least class
    with each other that fits, and the group's members (a, null, size_a, s)."""
    batches = list(batches)
    if not batches:
        return
    s, c, size, edges = _groups(batches)
    counts = np.diff(edges)
    out: list[list[np.ndarray]] = [[], [], [], []]

    def take(x, y):
        fit = 100 * size[x].astype(np.int64) >= percent * size[y].astype(np.int64)
        for to, v in zip(out, (c[x[fit]], c[y[fit]], size[x[fit]], size[y[fit]]), strict=True):
            to.append(v)

    for g in range(2, small + 1):  # all groups of g members at once
        at = edges[:-1][counts == g]
        for i in range(g):
            for j in range(i + 1, g):
                take(at + i, at + j)
    for g in np.flatnonzero(counts > small).tolist():
        members = np.arange(edges[g], edges[g + 1])
        least = int(members[np.argmin(c[members])])
        take(members[members < least], np.full(int((members < least).sum()), least))
        take(np.full(int((members > least).sum()), least), members[members > least])
    a, b, size_a, size_b, n = _unique_pairs(*out)
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((a, b, size_a, size_b, n), FIRST.types, strict=False)] + [pa.nulls(len(a), pa.int64())], schema=FIRST)
    crowded = np.repeat(counts > small, counts) if len(counts) else np.zeros(0, bool)
    c, size, s = c[crowded], size[crowded], s[crowded]
    yield pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(len(c), pa.int64()), pa.array(size, pa.int32()), pa.nulls(len(c), pa.int32()), pa.nulls(len(c), pa.int64()), pa.array(s)], schema=FIRST)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the hashes' low bits, as 64-bit words."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def bitmap_bits(size: int) -> int:
    return min(4096, max(64, 1 << (2 * size - 1).bit_length()))


def band(size: F.Column) -> F.Column:
    """Sizes of linked sets lie in one band or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(4 / 3))).cast("int")


def _decide(table: pa.Table, percent: int) -> pa.Table:
    """One tile: rows (a, c, size, set) with one row c = a or more; the classes that link with a."""
    a, c, sizes = table.column("a")[0].as_py(), table.column("c").to_numpy(), table.column("size").to_numpy().astype(np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
    own = np.flatnonzero(c == a)
    out = []
    if len(own):
        mine, size = sets[own[0]], int(sizes[own[0]])
        for i in np.flatnonzero(c != a).tolist():
            both = len(np.intersect1d(mine, sets[i], assume_unique=True))
            if 100 * both >= percent * (size + int(sizes[i]) - both):
                out.append(int(c[i]))
    return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})


def _sets(batches, n: int):
    """The set of each class, once for each class and task."""
    seen: set[int] = set()
    for batch in batches:
        keys, sets = [], []
        for k, s in zip(batch.column("c").to_pylist(), (s for c in ta.chunks(batch.column("text")) for s in shingle_sets(c, n)), strict=True):
            if k not in seen:
                seen.add(k)
                keys.append(k)
                sets.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "size", "set"])


def _allowed(batches, percent: int):
    """The pairs whose bitmaps allow a link."""
    for batch in batches:
        size_a, size_b = (batch.column(x).to_numpy().astype(np.int64) for x in ("size_a", "size_b"))
        maps = [[np.frombuffer(x, np.uint64) for x in batch.column(y).to_pylist()] for y in ("bits_a", "bits_b")]
        words = [np.array([len(x) for x in m], np.int64) for m in maps]
        differing = np.zeros(batch.num_rows, np.int64)
        for a, b in {*zip(words[0].tolist(), words[1].tolist(), strict=True)}:
            own = np.flatnonzero((words[0] == a) & (words[1] == b))
            x, y = (_folded(np.stack([m[i] for i in own]), min(a, b)) for m in maps)
            differing[own] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        total = size_a + size_b
        most = np.minimum((total - differing) // 2, np.minimum(size_a, size_b))  # bit counts bound the overlap from above
        fit = pa.array(100 * most >= percent * (total - most))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("size_b")], ["a", "b", "size"]).filter(fit)


def _with_bits(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    for x in "ab":
        pairs = pairs.join(bits.select(F.col("c").alias(x), F.col("bits").alias(f"bits_{x}")).hint("merge"), x)
    return pairs


def _decided(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, size) with the size of b, those that link. A class's partners are dealt to tiles by size band and then to salts of about TILE."""
    members = pairs.join(sets.select(F.col("c").alias("b"), "set").hint("merge"), "b").withColumn("band", band(F.col("size")))
    tiles = pairs.groupBy("a", band(F.col("size")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    tiles = tiles.select("a", "band", F.ceil(F.col("n") / TILE).cast("int").alias("salts"))
    members = members.join(tiles, ["a", "band"]).select("a", "band", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("c"), "size", "set")
    heads = tiles.select("a", "band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets.select(F.col("c").alias("a"), "size", "set").hint("merge"), "a")
    rows = heads.select("a", "band", "salt", F.col("a").alias("c"), "size", "set").union(members)
    return rows.groupBy("a", "band", "salt").applyInArrow(lambda t: _decide(t, percent), "a long, b long")


def _apart_pairs(batches, percent: int, leaders: int):
    """Of large groups, the pairs of different components whose sizes fit and whose bitmaps allow a link, in blocks. With
    `leaders`, only pairs with that many of a group's members, those first by a hash."""
    batches = list(batches)
    if not batches:
        return
    got = pa.Table.from_batches(batches)
    s, c, size, comp = (got.column(x).to_numpy() for x in ("s", "c", "size", "comp"))
    maps, keys = [np.frombuffer(x, np.uint64) for x in got.column("bits").to_pylist()], got.column("keys").to_pylist()
    sets = [frozenset(x) for x in keys]

    def met_here(r: int, others: np.ndarray) -> np.ndarray:
        """Two members may meet in many groups: those of the pairs that do not meet in an earlier one, as far as is known."""
        at, own = int(s[r]), sets[r]
        return np.array([min(own & sets[t], default=at) == at for t in others.tolist()], bool)

    by = np.lexsort((c, size, s))
    edges = np.flatnonzero(np.concatenate([[True], s[by][1:] != s[by][:-1], [True]]))
    out: list[list[np.ndarray]] = [[], [], [], []]

    def take(r: int, others: np.ndarray):
        for to, v in zip(out, (np.full(len(others), c[r]), c[others], np.full(len(others), size[r]), size[others]), strict=True):
            to.append(v)

    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = by[x:y]
        sizes = size[rows].astype(np.int64)
        if leaders:
            for r in rows[np.argsort(ta.mix(c[rows].view(np.uint64)))[:leaders]].tolist():
                tail = rows[comp[rows] != comp[r]]
                if len(tail):
                    words = np.array([min(len(maps[r]), len(maps[t])) for t in tail])
                    differing = np.array([np.bitwise_count(_folded(maps[r], w) ^ _folded(maps[t], w)).sum() for t, w in zip(tail, words.tolist(), strict=True)], np.int64)
                    total = size[r] + size[tail].astype(np.int64)
                    most = np.minimum((total - differing) // 2, np.minimum(size[r], size[tail]))
                    fit = 100 * most >= percent * (total - most)
                    tail = tail[fit]
                    take(r, tail[met_here(r, tail)])
            continue
        for i in range(0, len(rows), TILE):
            head = rows[i : i + TILE]
            least_bits = min(len(maps[r]) for r in head)
            last = int(np.searchsorted(sizes, 100 * sizes[min(i + TILE, len(rows)) - 1] // percent, "right"))
            first = np.stack([_folded(maps[r], least_bits) for r in head])
            for j in range(i, last, TILE):
                tail = rows[j : min(j + TILE, last)]
                others = np.stack([_folded(maps[r], least_bits) for r in tail])
                for h in range(len(head)):  # one row of the block at a time bounds the memory
                    r = head[h]
                    total = size[r] + size[tail].astype(np.int64)
                    most = (total - np.bitwise_count(others ^ first[h]).sum(1, dtype=np.int64)) // 2
                    most = np.minimum(most, np.minimum(size[r], size[tail]))
                    fit = (comp[tail] != comp[r]) & (100 * most >= percent * (total - most))
                    if fit.any():
                        found = tail[fit]
                        take(int(r), found[met_here(int(r), found)])
    a, b, _, of_b, _ = _unique_pairs(*out)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(of_b, pa.int32())], ["a", "b", "size"])


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (in the last dimension) of fewer words: the parity of the halves laid over each other."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _likely(pairs: DataFrame, crowds: DataFrame, percent: int) -> DataFrame:
    """The pairs that share enough of their prefixes. Of the set whose prefix ends first, each shared shingle lies in both
    prefixes or beyond its own; so the overlap is at most the shared prefix shingles plus what is beyond. Shingles of large
    groups were not counted pair by pair: as many as both have of them may be shared."""
    pairs = pairs.groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.sum("n").alias("n"))
    many = crowds.groupBy("c").agg(F.count(F.lit(1)).alias("many"))
    for x in "ab":
        pairs = pairs.join(many.select(F.col("c").alias(x), F.col("many").alias(f"many_{x}")), x, "left")
    least = F.ceil(F.lit(percent) * (F.col("size_a") + F.col("size_b")) / F.lit(100 + percent))
    beyond = [F.ceil(F.lit(percent) * F.col(f"size_{x}") / F.lit(100)) - 1 for x in "ab"]
    most = F.col("n") + F.least(*(F.coalesce(f"many_{x}", F.lit(0)) for x in "ab")) + F.greatest(*beyond)
    return pairs.where(most >= least - F.lit(1e-6)).select("a", "b", "size_a", "size_b")


def jaccard_links(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, small: int = SMALL, sample_of: int = SAMPLE_OF, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, text): members (doc_id, h, size, c) with the hash h of each document's text and its class c, and
    links (a, b) between classes: enough of them to connect all that are similar."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    sampled = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample_of)) == 0).select("text")
    counted = sampled.mapInArrow(ta.released(_frequent_in_sample, n=n), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n >= 3")
    found = counted.orderBy(F.desc("n"), "s").limit(frequent).toArrow()
    hashes, often = found.column("s").to_numpy().view(np.uint64), found.column("n").to_numpy()
    by = np.argsort(hashes)
    shared = spark.sparkContext.broadcast((hashes[by], often[by]))
    summary = cut(texts.mapInArrow(ta.released(_prefixes, n=n, percent=percent, frequent=shared), "doc_id long, h long, size int, c long, prefix array<long>, crowd array<long>, bits binary"))
    members = summary.select("doc_id", "h", "size", "c")
    classes = summary.where("prefix IS NOT NULL")

    postings = classes.select("c", "size", F.explode("prefix").alias("s"))
    total = summary.agg(F.sum(F.size("prefix").cast("long")).alias("n")).first()[0] or 0
    parts = max(8, -(-max(0, total) // POSTINGS))
    dealt = postings.repartition(parts, "s")
    first = cut(dealt.mapInArrow(ta.released(_first_pairs, percent=percent, small=small), FIRST_SQL))
    crowds = first.where("b IS NULL").select(F.col("a").alias("c"), "s", F.col("size_a").alias("size"))
    # Of the very frequent shingles only the least class is gathered; each other one that fits it is its candidate.
    hot = cut(classes.select("c", "size", F.explode("crowd").alias("s")).distinct())
    least = hot.groupBy("s").agg(F.min(F.struct("c", "size")).alias("x")).select("s", F.col("x.c").alias("a"), F.col("x.size").alias("size_a"))
    fits = F.lit(100) * F.least("size_a", "size") >= F.lit(percent) * F.greatest("size_a", "size")
    starred = hot.join(least, "s").where((F.col("a") < F.col("c")) & fits)
    starred = starred.groupBy("a", F.col("c").alias("b")).agg(F.first("size_a").alias("size_a"), F.first("size").alias("size_b"), F.count(F.lit(1)).alias("n"))
    crowds = crowds.unionByName(hot)
    found = first.where("b IS NOT NULL").select("a", "b", "size_a", "size_b", "n").unionByName(starred)
    # Written once, so that joins with it read nothing but shuffles, which adaptive execution can split where a class is hot.
    bits = cut(classes.select("c", "bits").dropDuplicates(["c"]))
    pairs = cut(_with_bits(_likely(found, crowds, percent), bits).mapInArrow(ta.released(_allowed, percent=percent), "a long, b long, size int"))

    # One row of each class gives its text; rows that share an id may have other texts, which their hash tells apart.
    heads = members.where("size > 0 AND doc_id IS NOT NULL").groupBy("c").agg(F.min(F.struct("doc_id", "h")).alias("d"))
    chosen = pairs.select(F.explode(F.array("a", "b")).alias("c")).union(crowds.select("c")).distinct().join(heads, "c")
    # The classes grow with the documents: one plan at every size.
    sets = texts.join(chosen.select("c", "d.doc_id", "d.h").hint("merge"), ["doc_id", "h"]).select("c", "text")
    sets = cut(sets.mapInArrow(ta.released(_sets, n=n), "c long, size int, set binary"))
    links = cut(_decided(pairs, sets, percent))

    for leaders in (LEADERS, 0):
        label = components(links).withColumnRenamed("node", "c")
        inside = crowds.join(label, "c", "left").withColumn("comp", F.coalesce("component", "c"))
        apart = inside.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("s")
        inside = inside.join(apart, "s")
        # A few of each member's groups, so that a pair that meets in several is looked at in one.
        first = inside.groupBy("c").agg(F.slice(F.sort_array(F.collect_set("s")), 1, MEETINGS).alias("keys"))
        inside = inside.join(first, "c").join(bits.hint("merge"), "c").select("s", "c", "size", "comp", "bits", "keys")
        more = inside.repartition(parts, "s").mapInArrow(ta.released(_apart_pairs, percent=percent, leaders=leaders), "a long, b long, size int").distinct()
        more = cut(more.join(pairs, ["a", "b"], "left_anti"))
        pairs = pairs.union(more)
        links = links.union(cut(_decided(more, sets, percent)))
    return members, links


def _grouped(docs: DataFrame, n: int, percent: int, **options) -> DataFrame:
    """For each row doc_id, h (hash of its text), size, component_id, and whether it stays if one of each component does."""
    members, links = jaccard_links(docs, n, percent, **options)
    label = components(links)
    classes = members.where("size > 0").groupBy("c").agg(F.min("doc_id").alias("d"))
    roots = classes.join(label.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("component", "c").alias("root"), "d")
    # Ties of an id between classes go to the least class.
    least = roots.where("d IS NOT NULL").groupBy("root").agg(F.min(F.struct("d", "c")).alias("x")).select("root", F.col("x.d").alias("component_id"), F.col("x.c").alias("first"))
    of_class = roots.join(least, "root").select("c", "component_id", "first")
    out = members.join(of_class, "c", "left")
    own = (F.col("size") == 0) | F.col("doc_id").isNull()
    stays = own | (F.col("doc_id") == F.col("component_id")) & (F.col("c") == F.col("first"))
    return out.select("doc_id", "h", "size", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), stays.alias("stays"))


def jaccard_join(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, **options) -> DataFrame:
    """For each document doc_id, n_shingles and component_id, the least doc_id that links lead to."""
    return _grouped(docs, n, percent, **options).select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")


def without_near_copies(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one with the least id, and of several texts of that
    id the one of the least class. Rows equal in id and text stay or go together; rows without words or without an id stay.
    Rows of one id with unlike texts are judged on their own. An empty table gives an empty result."""
    gone = _grouped(docs.select("doc_id", "text"), n, percent).where("NOT stays").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__gone_h")).distinct()
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__gone")) & (F.xxhash64("text") == F.col("__gone_h")), "left_anti").select(docs.columns)
