import base64
import hashlib
import random
import struct

import pytest
from tests.llm.cases import SCHEMA, documents

from corpusloom.llm.prefix_bpe import Prefixes, PrefixTokenizer, decode_documents, encode_documents

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return PrefixTokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(3)
    letters = "aaabcde  eeéüß日本語😀\n\t..,!'’01"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(300)]
    return texts + ["<|endoftext|>", " " * 500, "a" * 700, "ab" * 400, "\x00\x01", "don't we'll", "١٢٣ ½", "á" * 30] + [t for _, t, *_ in documents() if t]


def test_equals_the_library(tokenizer, library):
    import regex

    for text in odd_texts():
        got = [i for piece in regex.findall(P.PATTERN, text) for i in tokenizer.encode(piece.encode())]
        assert got == library.encode_ordinary(text)
        assert tokenizer.decode(got) == text.encode()


def test_appends_and_edits(tokenizer):
    r = random.Random(8)
    for _ in range(40):
        data = bytes(r.choice(b"abcde the ing\xc3\xa9") for _ in range(r.randint(1, 300)))
        kept = Prefixes(tokenizer, data[: len(data) // 2])
        kept.append(data[len(data) // 2 :])
        assert kept.ids() == tokenizer.encode(data)
        at = r.randint(0, len(data))
        assert kept.ids(at) == (tokenizer.encode(data[:at]) if at else [])
        removed, inserted = r.randint(0, min(5, len(data) - at)), bytes(r.choice(b"xyz the") for _ in range(r.randint(0, 6)))
        again = kept.edit(at, removed, inserted)
        data = data[:at] + inserted + data[at + removed :]
        assert kept.data == data and kept.ids() == (tokenizer.encode(data) if data else [])
        assert again <= len(data) - at
    long = b" the house of the hill" * 200
    kept = Prefixes(tokenizer, long)
    assert kept.edit(100, 3, b"cat") < len(long) // 4
    assert kept.ids() == tokenizer.encode(kept.data)


def test_documents(spark, library):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    encoded = encode_documents(docs, PATH, P.PATTERN, with_ids=True)
    text = {r[0]: r[1] or "" for r in rows}
    for r in encoded.collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    for r in decode_documents(encoded, PATH, P.PATTERN).collect():
        assert bytes(r.bytes) == text[r.doc_id].encode()
    assert encode_documents(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0
