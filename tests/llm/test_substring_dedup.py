import hashlib

import pytest
from tests.llm.cases import SCHEMA, documents

from corpusloom.llm.substring_dedup import substring_dedup, without_repeats


def brute(rows, window):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in words:
        key = -(1 << 63) if d is None else d
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, key), key)
    out = []
    for d, w in words:
        key, gone = -(1 << 63) if d is None else d, set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,gram", [(50, 10), (12, 4)])
def test_equals_brute_force(spark, window, gram):
    rows = documents()
    rows += [(None, rows[3][1], *rows[3][2:]), rows[7], rows[7], (None, rows[9][1], *rows[9][2:])]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), window=window, gram=gram, piece=3 * window).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)
    assert any(r.n_removed for r in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).count() == 0
    assert without_repeats(empty).columns == empty.columns


def test_documents_keep_their_columns(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert set(got) == {r[0] for r in rows}
    for doc_id, n_words, n_removed, digest in brute(rows, 50):
        text = got[doc_id].text
        assert hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest() == digest
        if not n_removed:
            assert text == next(r[1] for r in rows if r[0] == doc_id)


def test_hot_grams_are_routed_by_windows(spark, monkeypatch):
    """A common line shorter than a window sends no passage anywhere, and no removal is lost."""
    from corpusloom.llm import substring_dedup as s

    rows = documents()
    line = " ".join(f"line{i}" for i in range(14))
    rows += [(5000 + i, " ".join([rows[i % 40][1] or "x", line, *(f"own{i}_{j}" for j in range(30)), line]), *rows[0][2:]) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for fan_out in (0, 20):
        monkeypatch.setattr(s, "FAN_OUT", fan_out)
        monkeypatch.setattr(s, "BUCKET_BYTES", 4096)
        assert sorted(map(tuple, substring_dedup(docs).collect()), key=str) == brute(rows, 50)


def test_a_very_long_text(spark):
    import random

    r = random.Random(8)
    long = [f"w{r.randrange(40_000)}" for _ in range(700_000)]
    rows = [(1, " ".join(long[300_000:300_200]), "en", "s", 1, 1, "k"), (2, " ".join(long), "en", "s", 1, 1, "k")]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].n_removed, got[2].n_words, got[2].n_removed) == (0, 700_000, 200)
    assert got[2].kept_sha256 == hashlib.sha256(" ".join(long[:300_000] + long[300_200:]).encode()).hexdigest()
