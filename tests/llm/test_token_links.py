import hashlib
from collections import Counter

import pytest
from tests.llm.cases import SCHEMA, documents

from corpusloom.llm import token_links as T

P = pytest.importorskip("public_tokenizers")
JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    """Whole texts through the libraries, with dicts of ends."""
    a, b, of_a, of_b = T._loaded(JSON, MODEL)
    read, counts = [], Counter()
    for doc_id, text in rows:
        whole = " " + (text or "")
        ids_a, ids_b = (a.encode(whole, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if b"".join(of_a[i] for i in ids_a) != whole.encode() or b"".join(of_b[i] for i in ids_b) != whole.encode():
            ids_a = ids_b = []
        ends = []
        for ids, of in ((ids_a, of_a), (ids_b, of_b)):
            at, found = 0, {}
            for i in ids:
                at += len(of[i])
                found[at] = i
            ends.append(found)
        pairs = [(ends[0][e], ends[1][e]) for e in sorted(ends[0]) if e in ends[1]]
        counts.update(pairs)
        read.append((doc_id, ids_a, ids_b, ends, pairs))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, ids_a, ids_b, ends, pairs in read:
        groups, group = [], ([], [])
        for e in sorted(set(ends[0]) | set(ends[1])):
            for k in (0, 1):
                if e in ends[k]:
                    group[k].append(str(ends[k][e]))
            if e in ends[0] and e in ends[1]:
                groups.append("|".join(map(",".join, group)))
                group = ([], [])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return sorted(out, key=str)


ODD = ["a  b   c ", "  x", " ", "   ", "\n", "a\n b \n\n c", "tab\t \tx  ", "<|endoftext|> <s> </s> <unk> <0x0A>", "don't we'll 12 3", "á  ß　x \xa0y", "one▁two three", "\r\n line\r\n two", "...  !!", "😀 😀😀", "x" * 3000, "ab " * 3000]


def found(docs):
    names = ("doc_id", *T.NUMBERS, "groups_sha256")
    out = T.token_links(docs, JSON, MODEL)
    assert [c for c, k in out.dtypes if k == "bigint"] == list(names[:-1])
    return sorted(((*(r[c] for c in names),) for r in out.collect()), key=str)


def test_equals_whole_texts(spark):
    rows = documents() + [(1000 + i, t, "en", "a", len(t), 1, "x") for i, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None, "no id at all", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs) == brute([r[:2] for r in rows])


def test_segments_of_plain_and_odd_texts():
    for text in ODD + [r[1] for r in documents() if r[1]]:
        assert T._cut(text) == [s[1:] for s in T._PLACE.split(" " + text)] and " " + " ".join(T._cut(text)) == " " + text


def test_tables_without_tokens(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, None, "", "", 0, 0, ""), (2, "", "", "", 0, 0, ""), (3, "a▁", "", "", 0, 0, "")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute([r[:2] for r in rows])


def test_texts_that_differ_are_left_out(spark, monkeypatch):
    """Whatever segment has other bytes, its documents have no tokens and count for no pair."""

    def odd(batches, byte_json, piece_model):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in real(batches, byte_json, piece_model):
            yield b.set_column(2, "same", pc.and_(b.column("same"), pc.not_equal(b.column("segment"), pa.scalar("bad"))))

    real = T._tokens
    monkeypatch.setattr(T, "_tokens", odd)
    rows = [(i, t, "", "", 0, 0, "") for i, t in enumerate(["some good words", "a bad word", "good", "bad bad", "words of bad"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute([(i, t) if "bad" not in t else (i, None) for i, t, *_ in rows])
    assert found(docs) == want
