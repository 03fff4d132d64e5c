import hashlib

from pyspark.sql import functions as F
from tests.llm.cases import SCHEMA, documents

from corpusloom.llm import spot_signatures as s


def chains(text):
    words = "".join(" " if c in "\n\t\r\x0b\x0c" else c for c in text.lower() if c not in s.MARKS).split(" ")
    words, out = [w for w in words if w], set()
    for i, w in enumerate(words):
        content = [x for x in words[i + 1 :] if x not in s.ANCHORS][: s.CHAIN]
        if w in s.ANCHORS and len(content) == s.CHAIN:
            out.add(" ".join([w, *content]))
    return out or ({" ".join(words)} if words else set())


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "BUCKET_ROWS", 9)
    rows = documents() + [(900, "The cat of the mat sat in a hat.", "en", "s", 1, 1, "k"), (901, "the of the", "en", "s", 1, 1, "k"), (None, "after all the other cats sat", "en", "s", 1, 1, "k")]
    got = {r.doc_id: r for r in s.spot_signatures(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    seen = {}
    for i, (d, t) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        edit = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert abs(r.near_edited - alike(chains(t), chains(edit))) < 1e-12
        assert abs(r.near_next - alike(chains(t), chains(other))) < 1e-12
        assert len(r.fingerprint) == 8 * len(chains(t))
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint


def test_pruning_never_raises_a_likeness(spark):
    rows = [([1, 2, 3], [1, 2, 3, 4]), ([1], [1, 2, 3, 4, 5]), ([], [1]), ([], [])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    got = [tuple(r) for r in df.select(s.likeness(F.col("a"), F.col("b")), s.likeness(F.col("a"), F.col("b"), 0.5)).collect()]
    assert got == [(0.75, 0.75), (0.2, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_one_row_and_none(spark):
    one = s.spot_signatures(spark.createDataFrame([(1, "the cat sat", "en", "s", 1, 1, "k")], SCHEMA)).collect()
    assert one[0].near_next == 1.0
    assert s.spot_signatures(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matches_equal_brute_force(spark):
    rows = documents() + [(None, "after all the other cats sat", "en", "s", 1, 1, "k")]
    docs = spark.createDataFrame(rows, SCHEMA)
    queries = docs.where("doc_id % 2 = 0 OR doc_id IS NULL")
    for floor in (0.4, 0.75):
        got = sorted(((r.query_id, r.doc_id, round(r.likeness, 9)) for r in s.spot_matches(queries, docs, floor).collect()), key=str)
        sets = [(d, chains(t or "")) for d, t, *_ in rows]
        want = [(a, b, round(alike(x, y), 9)) for a, x in sets if a is None or a % 2 == 0 for b, y in sets if x and y and alike(x, y) >= floor]
        assert got == sorted(want, key=str)
    assert s.spot_matches(queries.limit(0), docs).count() == 0


def test_many_buckets_null_ids_and_a_long_text(spark, monkeypatch):
    """Ranges parted again, ids in clusters, null ids in several buckets, and one text of a few megabytes."""
    monkeypatch.setattr(s, "BUCKET_ROWS", 3)
    monkeypatch.setattr(s, "RANGES", 4)
    ids = [*range(0, 40), *range(10**12, 10**12 + 25), -5, -(10**15)]
    rows = [(i, f"the word{k} goes to town{k} and the end{k % 7} comes", "en", "s", 1, 1, "k") for k, i in enumerate(ids)]
    rows += [(None, f"in a word{k} of the house", "en", "s", 1, 1, "k") for k in range(20)] + [(77, "the longest of texts goes on " * 100_000, "en", "s", 1, 1, "k")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = s.spot_signatures(docs)
    assert got.count() == len(rows)
    known = sorted((r[:2] for r in rows if r[0] is not None), reverse=True)
    digests = {r.doc_id: (r.n_chars, r.edited_sha256) for r in got.where("doc_id IS NOT NULL").collect()}
    for (i, t), (_, other) in zip(known, known[1:], strict=False):
        assert digests[i] == (len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + other[: len(t) // 2]).encode()).hexdigest())
    last = known[-1]
    h = {r.text: r.h for r in docs.where("doc_id IS NULL").select("text", F.xxhash64("text").alias("h")).collect()}
    null_texts = sorted((r[1] for r in rows if r[0] is None), key=h.get)
    ring = [last[1], *null_texts, known[0][1]]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + o[: len(t) // 2]).encode()).hexdigest() for t, o in zip(ring[1:], ring[2:], strict=False))
    assert sorted(r.edited_sha256 for r in got.where("doc_id IS NULL").collect()) == want


def test_repeated_rows(spark):
    rows = [(1, "the cat sat in a hat", "en", "s", 1, 1, "k")] * 5 + [(0, "the dog ran to a tree", "en", "s", 1, 1, "k")]
    got = s.spot_signatures(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.near_next for r in got if r.doc_id == 1) == [0.0, 1.0, 1.0, 1.0, 1.0]
