"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

The encoding of a prefix of a piece ends with one token, and what is before that token is the encoding of the shorter prefix.
So one token for each prefix is enough to hold all encodings. A token is that last one if it ends the prefix and forms a
valid pair with the last token before it: a pair is valid if encoding the bytes of both gives these two tokens. Exactly one
candidate is valid. Bytes can be appended by going on from the last prefix. After an edit in the middle, prefixes are encoded
again from there until the last tokens of a whole longest token's length agree with the old ones; the rest then stays.

A text is cut by the tokenizer's pattern, and each match is encoded on its own. Each task keeps the ids of pieces and the
validity of pairs that it has met, up to a fixed number, so that a frequent piece is encoded once. The vocabulary is a file of
ranks in the tiktoken format; its path and the pattern are parameters, and nothing is copied from it.

Nulls and ties: a null or empty text has no tokens. Rows are independent of each other: there is no shuffle. An empty table
gives an empty result; other columns are ignored."""

import base64
import hashlib
import struct
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import small_batches

#: Pieces, and pairs of tokens, that a task remembers.
PIECES = 1 << 19
PAIRS = 1 << 20


class PrefixTokenizer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.table = [self.tokens.get(i, b"") for i in range(max(self.tokens, default=-1) + 1)]
        self.longest = max(map(len, ranks), default=1)
        # How long a token that ends with a byte can be at most.
        self.reach = [1] * 256
        for b in ranks:
            self.reach[b[-1]] = max(self.reach[b[-1]], len(b))
        self.pairs: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> "PrefixTokenizer":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """BPE by its definition: the pair of the least rank is merged until none has one. For single pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def valid(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    @cache  # noqa: B019  one tokenizer lives as long as its worker
    def whole(self, token: int) -> bool:
        """A token that encodes to itself; a vocabulary may hold some that no merges lead to."""
        return self.merged(self.tokens[token]) == [token]

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Append to last (last[j]: the last token of data[:j], last[0] unused) the entries of prefixes from start on."""
        ranks, pairs, valid, reach = self.ranks, self.pairs, self.valid, self.reach
        for j in range(start, len(data) + 1):
            for i in range(max(0, j - reach[data[j - 1]]), j):
                token = ranks.get(data[i:j])
                if token is None:
                    continue
                if i:
                    before = last[i]
                    good = pairs.get(before << 32 | token)
                    if valid(before, token) if good is None else good:
                        break
                elif j == 1 or self.whole(token):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)

    def read(self, last: list[int]) -> list[int]:
        out, j = [], len(last) - 1
        while j > 0:
            out.append(last[j])
            j -= len(self.tokens[last[j]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        if (token := self.ranks.get(data)) is not None and (len(data) == 1 or self.whole(token)):
            return [token]
        last = [-1]
        self.extend(data, last, 1)
        return self.read(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The encodings of all prefixes of one piece, kept exact under appends and edits."""

    def __init__(self, tokenizer: PrefixTokenizer, data: bytes = b""):
        self.tokenizer, self.data, self.last = tokenizer, data, [-1]
        tokenizer.extend(data, self.last, 1)

    def ids(self, length: int | None = None) -> list[int]:
        return self.tokenizer.read(self.last if length is None else self.last[: length + 1])

    def append(self, more: bytes) -> None:
        self.data += more
        self.tokenizer.extend(self.data, self.last, len(self.last))

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace `removed` bytes at `at`; how many prefixes were encoded again."""
        old, shift, total = self.last, len(inserted) - removed, len(self.data) + len(inserted) - removed
        self.data = self.data[:at] + inserted + self.data[at + removed :]
        self.last, agreed, j = old[: at + 1], 0, at
        while j < total:
            j += 1
            self.tokenizer.extend(self.data[:j] if j < total else self.data, self.last, j)
            agreed = agreed + 1 if j > at + len(inserted) and self.last[j] == old[j - shift] else 0
            if agreed >= self.tokenizer.longest:
                self.last += old[j - shift + 1 :]
                break
        return j - at


class _Known(dict):
    """Ids of pieces as little-endian 32-bit bytes, encoded when first asked for."""

    def __init__(self, tokenizer: PrefixTokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> bytes:
        ids = self.tokenizer.encode(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = out
        return out


@cache
def _loaded(path: str, pattern: str):
    import regex

    tokenizer = PrefixTokenizer.from_file(path)
    return tokenizer, _Known(tokenizer), regex.compile(pattern)


def _encoded(batches, path: str, pattern: str, with_ids: bool):
    tokenizer, known, splitter = _loaded(path, pattern)
    token = tokenizer.table.__getitem__
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for text in batch.column("text"):
            ids = b"".join(map(known.__getitem__, splitter.findall(text.as_py() or "")))
            decoded = b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))
            for to, v in zip(rows, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), np.frombuffer(ids, "<u4").astype(np.int32) if with_ids else None), strict=True):
                to.append(v)
        out = [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            out, names = [*out, pa.array(rows[3], pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(out, names)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """For each document doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256, and the
    ids if asked for."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_encoded, path=path, pattern=pattern, with_ids=with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def _decoded(batches, path: str, pattern: str):
    tokenizer, _, _ = _loaded(path, pattern)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([tokenizer.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "bytes"])


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of each row's ids (null: none)."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, path=path, pattern=pattern), "doc_id long, bytes binary")
