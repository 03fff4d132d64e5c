import math
import re
from collections import Counter, defaultdict

import pytest
from tests.llm.cases import SCHEMA, documents

from corpusloom.llm.mixing import by_length, mix_sources, mixed, targets


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share, cap, and share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        out = {s: most * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if out[s] > most * sizes[s] + 1e-9}
        if not above:
            return out
        capped |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 7}, {"a": 5}, {"a": 0, "b": 3}, {f"s{i:02}": (i * 37) % 101 + 1 for i in range(20)}, {"a": 0}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def many(n=3000):
    rows = documents()
    return rows + [(10_000 + i, " ".join(["w"] * (1 + i * 7919 % 97)), "en", ["hot", "a", "b"][min(2, i % 7)], 1, 1, "k") for i in range(n)] + [rows[1], rows[1]]


def test_taken_words(spark):
    rows = many()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sizes, taken = Counter(), Counter()
    for d, _, _, s, *_ in rows:
        sizes[s] += size[d]
    want = brute_targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.02 * want[s])
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_sample_is_fair(spark):
    """In a source that is drawn in part, long and short documents are drawn alike."""
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 40)), "en", "a" if i < 4000 else "b", 1, 1, "k") for i in range(6000)]
    share = defaultdict(list)
    for r in mix_sources(spark.createDataFrame(rows, SCHEMA)).collect():
        if r.target < 2 * r.source_size - 1:
            share[r.size].append(r.taken / r.size)
    a, b = (sum(x) / len(x) for x in share.values())
    assert abs(a - b) < 0.1


def test_mixed_rows(spark):
    rows = many(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixed(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    taken = Counter()
    source = {r[0]: r[3] for r in rows}
    for r in mix_sources(docs).collect():
        taken[source[r.doc_id]] += r.taken
    assert +words == +taken


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_sources(empty).count() == 0
    assert mixed(empty).count() == 0


def test_weights_make_unequal_probabilities(spark):
    """Expected copies follow the weight, certain copies come first, and the order of the sample is not that of u."""
    rows = [(i, " ".join(["w"] * (5 + i % 60)), "en", "a" if i < 3000 else "b", 1, 1, "k") for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs, weight=by_length()).collect()
    words = Counter()
    for r in got:
        words[r.target] += r.taken
    assert all(abs(n - t) <= max(2, 0.002 * t) for t, n in words.items())
    part = [r for r in got if r.target < 2 * r.source_size - 1]
    assert part
    # The level at which the expected words are the target, by bisection over all documents.
    low, high = 0.0, 10.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(r.size * min(2, mid * math.sqrt(r.size)) for r in part) < part[0].target else (low, mid)
    by_size = defaultdict(list)
    for r in part:
        by_size[r.size].append(r.taken / r.size)
    for size, copies in by_size.items():
        expected = min(2, low * math.sqrt(size))
        assert min(copies) >= math.floor(expected - 0.02) and max(copies) <= math.ceil(expected + 0.02)
    for some in (range(5, 15), range(30, 40), range(55, 65)):
        mean = sum(sum(by_size[x]) for x in some) / sum(len(by_size[x]) for x in some)
        want = sum(min(2, low * math.sqrt(x)) * len(by_size[x]) for x in some) / sum(len(by_size[x]) for x in some)
        assert abs(mean - want) < 0.08
    # With one probability for all, whoever has a smaller u is drawn first; here some with a larger u are drawn and others not.
    u = {r[0]: r[1] for r in docs.selectExpr("doc_id", f"pmod(xxhash64(xxhash64(11, cast(doc_id AS string), text)), {1 << 52})").collect()}
    drawn = [u[r.doc_id] for r in part if 0 < r.size and r.taken > r.size * math.floor(min(2, low * math.sqrt(r.size)))]
    left = [u[r.doc_id] for r in part if r.taken == r.size * math.floor(min(2, low * math.sqrt(r.size))) and low * math.sqrt(r.size) < 2]
    assert max(drawn) > min(left)


def test_weight_column_and_odd_rows(spark):
    """Null and negative weights, null ids, repeated rows that hold most of a source, and a very long text."""
    rows = [(7, "a b c", "en", "hot", 1, 1, "k")] * 500 + [(None, "x y", "en", "hot", 1, 1, "k"), (None, "x y", "en", None, 1, 1, "k"), (None, None, "en", None, 1, 1, "k")]
    rows += [(i, "w " * 20, "en", "b", 1, [None, -1, 0, 3, 9][i % 5], "k") for i in range(100, 300)] + [(900, "long " * 400_000, "en", "c", 1, 1, "k")]
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    got = mix_sources(docs, weight=F.col("bucket")).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    b = [r for i in range(100, 300) for r in by_id[i]]
    if b[0].target < 2 * b[0].source_size:
        assert all(r.taken == 0 for r in b if r.doc_id % 5 < 3) or sum(r.taken for r in b) > 0
    out = mixed(docs, weight=F.col("bucket"))
    assert out.columns == docs.columns
    words = Counter(r.source for r in out.collect() for _ in (r.text or "").split())
    taken = Counter()
    for r, (_, _, _, s, *_) in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.size, r.source_size)), sorted(rows, key=lambda r: (r[0] or -1, len((r[1] or "").split()))), strict=True):
        taken["all"] += r.taken
    assert sum(words.values()) == taken["all"]
