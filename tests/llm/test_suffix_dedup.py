import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tests.llm.cases import SCHEMA, documents

from corpusloom.llm.suffix_dedup import recurring, suffix_dedup, two_stage_order


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(x[i : i + length] for _, x in texts for i in range(len(x) - length + 1))
    out = []
    for d, x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(12))
def test_two_stage_order(seed):
    r = random.Random(seed)
    pieces = ["".join(r.choice("ab" if seed % 2 else "abcé") for _ in range(r.randint(1, 60))).encode() for _ in range(30)] + [b"aaaaaaaaaa", b"aaaaaaaaaa", b"b"]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    stops = np.repeat(ends, [len(p) for p in pieces])
    wanted = np.array(sorted(r.sample(range(len(text)), len(text) // 2)))
    got = two_stage_order(text, stops, wanted, 1000)
    assert sorted(got.tolist()) == wanted.tolist()
    keys = [text[p : stops[p]].tobytes() for p in got]
    assert keys == sorted(keys)
    for length in (3, 9):
        starts = np.array([p for p in range(len(text)) if stops[p] - p >= length])
        seen = Counter(text[p : p + length].tobytes() for p in starts)
        assert recurring(text, stops, starts, length).tolist() == [seen[text[p : p + length].tobytes()] > 1 for p in starts]


@pytest.mark.parametrize("length,gram", [(400, 64), (40, 10)])
def test_equals_brute_force(spark, length, gram):
    rows = documents()
    rows += [(None, rows[3][1], *rows[3][2:]), rows[7], rows[7], (None, rows[9][1], *rows[9][2:]), (5, "x" * 900, *rows[9][2:]), (5, "y" * 401, *rows[9][2:])]
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), length=length, gram=gram).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("shard_bytes", [1, 3000])
def test_hot_grams_are_split(spark, shard_bytes):
    """Passages shorter and longer than a string in many unlike documents, periodic texts, and repeated rows."""
    r = random.Random(6)
    own = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    short, long = own(30), own(130)
    rows = [(i, own(r.randint(0, 90)) + r.choice([short, long, long[:60]]) + own(r.randint(0, 90)), "en", "s", 1, 1, "k") for i in range(120)]
    rows += [(500 + i, "ab" * (25 + i) + own(5), "en", "s", 1, 1, "k") for i in range(6)] + [rows[0], rows[0], (None, *rows[3][1:]), (None, *rows[4][1:]), (rows[5][0], *rows[6][1:])]
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), length=40, gram=8, shard_bytes=shard_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 40)


def test_a_very_long_text_and_kept_bytes(spark):
    r = random.Random(7)
    text = "".join(r.choice("abcdefghijklmnop é") for _ in range(2_000_000))
    rows = [(1, text, "en", "s", 1, 1, "k"), (2, "start " + text[900_000:901_000], "en", "s", 1, 1, "k"), (3, None, "en", "s", 1, 1, "k")]
    got = {r.doc_id: r for r in suffix_dedup(spark.createDataFrame(rows, SCHEMA), with_bytes=True).collect()}
    gone = len(text[900_000:901_000].encode())
    assert got[1].n_removed >= gone and got[2].n_removed >= gone and got[3].n_removed == 0
    assert bytes(got[2].kept) in b"start " + text[900_000:900_002].encode() + text[901_000:901_000].encode() or len(got[2].kept) <= 6


@pytest.mark.parametrize("text", [b"-" * 1_000_000, b"| --- " * 170_000, b"\0\0a" * 300_000], ids=["dashes", "rules", "zeros"])
def test_memory_of_texts_that_tie(text):
    """Numpy's own memory for a megabyte of one text whose strings are all equal."""
    import tracemalloc

    data = np.frombuffer(text, np.uint8)
    starts = np.arange(len(data) - 399)
    tracemalloc.start()
    assert recurring(data, np.full(len(data), len(data)), starts, 400).all()
    assert tracemalloc.get_traced_memory()[1] < 90 * len(data)
    tracemalloc.stop()
