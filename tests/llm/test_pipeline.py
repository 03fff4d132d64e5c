import base64
import hashlib
import random
import re
import struct
from collections import Counter

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def made(tmp_path_factory, spark):
    """A corpus with bad documents, exact and near copies, and a shared passage."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice(["an", "er", "the", "on", "st", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(900)]
    passage = [r.choice(vocabulary) for _ in range(70)]
    rows, labels = [], []
    for i in range(160):
        words = [r.choice(vocabulary) for _ in range(r.randint(80, 260))]
        if i % 10 == 3:
            words[20:20] = passage
        text = " ".join(words)
        if i % 8 == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 0 if i % 8 == 0 else 1, 0))
    for i in range(1, 40, 4):
        words = rows[i][1].split()
        words[5] = "other"
        rows.append((200 + i, " ".join(words), "en", "s0", 1))
        rows.append((300 + i, rows[i][1], "en", "s1", 1))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows, dict((d, q) for d, q, _ in labels)


def test_stages(spark, made):
    import corpus_pipeline as p

    path, rows, quality = made
    text = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = p.cut(p.quality(spark, docs, path))
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept == {d for d in text if quality.get(d, 1)}

    unique = p.cut(p.near_copies(spark, good, path))
    assert unique.columns == docs.columns
    alone = {r.doc_id for r in unique.collect()}
    assert alone == {d for d in kept if d < 200}

    clean = p.cut(p.passages(spark, unique, path))
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    seen = set()
    for d in sorted(alone):
        w = text[d].split()
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        gone = {i + j for i, x in enumerate(windows) if x in seen for j in range(50)}
        seen |= set(windows)
        assert left[d].split() == [x for i, x in enumerate(w) if i not in gone]

    mix = p.cut(p.mix(spark, clean, path))
    assert mix.columns == docs.columns
    times = Counter(r.doc_id for r in mix.collect())
    assert max(times.values()) <= 2
    words, taken = Counter(), Counter()
    for r in clean.collect():
        words[r.source] += len(r.text.split())
        taken[r.source] += times[r.doc_id] * len(r.text.split())
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 0.05 * sum(words.values())

    out = p.encode(spark, mix, path).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    assert Counter(r.doc_id for r in out) == times
    for r in out:
        ids = library.encode_ordinary(left[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()

    whole = p.run(spark, path).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, out))
    assert re.fullmatch(r"[0-9a-f]{64}", whole[0].ids_sha256)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Null texts, sources and ids, repeated ids and rows, no labels; then no documents at all."""
    import corpus_pipeline as p

    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(90))
    shared = text()
    rows = [(1, shared, "en", "a", 1), (1, text(), "en", "a", 1), (None, text(), None, None, None), (None, shared, "en", None, 1), (2, None, "en", "a", 1), (3, "", "en", None, 0), (4, shared, "en", "b", 1), (5, shared, "en", "b", 1), (5, shared, "en", "b", 1), (6, text(), "en", None, 1)]
    kinds, labels = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"
    for name, given in (("odd", rows), ("none", [])):
        spark.createDataFrame(given, kinds).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], labels).write.parquet(str(tmp_path / name / "labels.parquet"))
    out = p.run(spark, str(tmp_path / "odd")).collect()
    assert {x.doc_id for x in out} <= {1, None, 6} and out
    assert p.run(spark, str(tmp_path / "none")).count() == 0
