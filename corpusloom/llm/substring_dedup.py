"""Substring deduplication with repeated-phrase automata.

A window is `window` consecutive words of one document; words are runs of bytes other than 0x20 and 0x09-0x0D. A word is
removed if a window that covers it also starts in a document with a smaller id. The work is done in four steps:

1. Each document gives the word sequences (grams) that are least by hash in some window (winnowing, about one word in
   twenty). Documents that share a window share such a gram, so a window can recur only around a gram of two documents.
2. Recurring passages are confirmed: the windows around recurring grams are counted by hash, each with its first document.
   That document's runs of windows that others have too are the passages; each distinct recurring window is in one.
3. Passages go to the buckets of documents that share a gram with them; documents that are alike are put in one bucket. A gram
   of many passages and many buckets, such as one of a line that is common but shorter than a window, sends a passage only to
   the buckets that hold one of its windows around that gram. In each bucket a pyahocorasick automaton is
   compiled from the passages' consecutive half-window tiles (every window that lies in a passage contains a whole tile).
   Words are single characters there, so that an automaton has a node for each word of the passages at most.
4. Each bucket's documents are streamed through its automaton. The windows around every hit are looked up among those of the
   bucket's passages, and removed from documents with a larger id than the passage's owner.

Automata are as large as their bucket's share of the repeated text, not of the corpus, and each document that has a recurring
gram passes through one automaton; the others hold no occurrence. No group is gathered: windows and grams are pre-aggregated by hash before they are shuffled. Hashes have
64 bits; a hit is confirmed by the hash of its window.

Nulls and ties: a null text has no words. A null id counts as smaller than all others. Rows with equal ids do not remove
each other's words. An empty table gives an empty result; other columns are ignored."""

import hashlib
import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta
from corpusloom.llm.scratch import cut, small_batches

WINDOW = 50
GRAM = 10
#: Words of a passage that are kept in one piece; pieces overlap by a window less one word.
PIECE_WORDS = 400
#: Bytes of candidate text in a bucket, about.
BUCKET_BYTES = 8 << 20
#: Documents with the same least recurring gram that stay together, about.
CROWD = 512
#: Passages times buckets of a gram, above which it does not send all of them to all: some hundred megabytes of passages.
FAN_OUT = 1 << 15
SMALLEST = -(1 << 63)
PARTS = re.compile(rb"[^ \t-\r]+[ \t-\r]*")


def _summaries(batches, window: int, gram: int):
    """For each document its words, digests of its text and of its words joined by a space, and its chosen grams."""
    for batch in batches:
        words, whole, digests, grams = [], [], [], []
        for c in ta.chunks(batch.column("text")):
            hashes, bounds = c.words()
            found, _, chosen = ta.local_minima(hashes, bounds, gram, window)
            at = np.flatnonzero(chosen)
            cuts = np.searchsorted(at, bounds)
            for i in range(c.size):
                text = c.text(i)
                whole.append(hashlib.sha256(text).hexdigest())
                digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                grams.append(ta.signed(np.unique(found[at[cuts[i] : cuts[i + 1]]])))
            words.append(np.diff(bounds))
        if grams:
            lengths = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("id"), pa.array(np.concatenate(words).astype(np.int64)), pa.array(whole), pa.array(digests), pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(grams)))],
                ["k", "id", "n_words", "text_sha", "kept_sha", "grams"],
            )


def _windows(batches, window: int, gram: int):
    """Hashes of the windows whose least gram recurs, with the document's key."""
    for batch in batches:
        keys, hits = batch.column("k").to_numpy(), batch.column("hits")
        for c in ta.chunks(batch.column("text")):
            hashes, bounds = c.words()
            _, least, _ = ta.local_minima(hashes, bounds, gram, window)
            if not len(least):
                continue
            of_window = ta.rolling_hash(hashes, window)
            out, doc = [], []
            for i in range(c.size):
                a, b = bounds[i], min(max(bounds[i + 1] - window + 1, bounds[i]), len(least))
                if b > a:
                    known = np.asarray(hits[c.first + i].values).view(np.uint64)
                    found = np.unique(of_window[a:b][np.isin(least[a:b], known)])
                    out.append(found)
                    doc.append(np.full(len(found), keys[c.first + i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(ta.signed(np.concatenate(out))), pa.array(np.concatenate(doc))], ["w", "k"])


def _windows_of_passages(batches, window: int, gram: int):
    """Hashes of the passages' windows whose least gram is among `hits`."""
    for batch in batches:
        out, whose = [], []
        for words, hits, passage in zip(batch.column("words").to_pylist(), batch.column("hits"), batch.column("passage").to_pylist(), strict=True):
            words = np.frombuffer(words, np.uint64)
            _, least, _ = ta.local_minima(words, np.array([0, len(words)]), gram, window)
            found = ta.rolling_hash(words, window)
            found = np.unique(found[np.isin(least[: len(found)], np.asarray(hits.values).view(np.uint64))])
            out.append(found)
            whose += [passage] * len(found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(ta.signed(np.concatenate(out))), pa.array(whose, pa.string())], ["w", "passage"])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _passages(batches, window: int, gram: int, piece: int):
    """The owner's maximal runs of recurring windows, as word hashes, each with its grams."""
    for batch in batches:
        keys, owned = batch.column("k").to_numpy(), batch.column("owned")
        own, words, grams = [], [], []
        for c in ta.chunks(batch.column("text")):
            hashes, bounds = c.words()
            of_window = ta.rolling_hash(hashes, window)
            for i in range(c.size):
                a, b = bounds[i], bounds[i + 1] - window + 1
                if b <= a:
                    continue
                for s, e in zip(*_runs(np.isin(of_window[a:b], np.asarray(owned[c.first + i].values).view(np.uint64))), strict=True):
                    for at in range(s, e, piece - window + 1):
                        part = hashes[a + at : a + min(e + window - 1, at + piece)]
                        found, _, chosen = ta.local_minima(part, np.array([0, len(part)]), gram, window)
                        own.append(keys[c.first + i])
                        words.append(ta.signed(part))
                        grams.append(ta.signed(np.unique(found[chosen])))
        if own:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(own, np.int64)), pa.array([x.tobytes() for x in words], pa.binary()), pa.array(grams, pa.list_(pa.int64())), pa.array([hashlib.blake2b(k.tobytes() + x.tobytes(), digest_size=16).hexdigest() for k, x in zip(own, words, strict=True)])],
                ["owner", "words", "grams", "passage"],
            )


def as_characters(hashes: np.ndarray) -> str:
    """One character for each word: twenty bits of its hash, above the surrogates."""
    return (np.uint32(0x10000) + (hashes >> np.uint64(44)).astype(np.uint32) % np.uint32(0xFFFF0)).astype("<u4").tobytes().decode("utf-32-le")


class PhraseAutomaton:
    """Automaton over the tiles of passages, and their windows by hash with the least owner of each.

    `covered(words, key)` marks the words of a document that belong to a window of a passage with an owner less than key:
    the automaton finds where tiles occur, and the windows around each occurrence are then looked up."""

    def __init__(self, passages: list[tuple[int, np.ndarray]], window: int):
        import ahocorasick

        self.window, self.tile = window, window // 2
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        hashes, owners = [], []
        for owner, words in passages:
            text = as_characters(words)
            for at in range(0, len(text) - self.tile + 1, self.tile):
                self.automaton.add_word(text[at : at + self.tile], 1)
            hashes.append(ta.rolling_hash(words, window))
            owners.append(np.full(len(hashes[-1]), owner, np.int64))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()
            by = np.lexsort((owners := np.concatenate(owners), hashes := np.concatenate(hashes)))
            hashes, owners = hashes[by], owners[by]
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            self.windows, self.owners = hashes[first], owners[first]

    def covered(self, words: np.ndarray, key: int) -> np.ndarray:
        out = np.zeros(len(words), bool)
        if self.empty or len(words) < self.window:
            return out
        ends = np.fromiter((end for end, _ in self.automaton.iter(as_characters(words))), np.int64)
        if not len(ends):
            return out
        # A window [i, i + window) contains a tile that ends at e if i <= e - tile + 1 and e < i + window.
        marks = np.zeros(len(words) + 1, np.int32)
        np.add.at(marks, np.maximum(ends - self.window + 1, 0), 1)
        np.add.at(marks, ends - self.tile + 2, -1)
        starts = np.flatnonzero(np.cumsum(marks)[: len(words) - self.window + 1] > 0)
        found = ta.rolling_hash(words, self.window)[starts]
        at = np.minimum(np.searchsorted(self.windows, found), len(self.windows) - 1)
        starts = starts[(self.windows[at] == found) & (self.owners[at] < key)]
        edges = np.zeros(len(words) + 1, np.int32)
        edges[starts] += 1
        edges[starts + self.window] -= 1
        return np.cumsum(edges[:-1]) > 0


def _stream(docs: pa.Table, passages: pa.Table, window: int) -> pa.Table:
    """One bucket: what is left of each document that loses words."""
    found = list(zip(passages.column("owner").to_pylist(), (np.frombuffer(x, np.uint64) for x in passages.column("words").to_pylist()), strict=True))
    automaton, rows = PhraseAutomaton(found, window), []
    for keys, part in zip(docs.column("k").chunks, docs.column("text").chunks, strict=True):
        for c in ta.chunks(part):
            hashes, bounds = c.words()
            for i in range(c.size):
                gone = automaton.covered(hashes[bounds[i] : bounds[i + 1]], key := keys[c.first + i].as_py())
                if gone.any():
                    text = c.text(i)
                    rows.append((key, hashlib.sha256(text).hexdigest(), int(gone.sum()), *_without(text, gone)))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [()] * 5, STREAMED.types, strict=True)], schema=STREAMED)


STREAMED = pa.schema([("k", pa.int64()), ("text_sha", pa.string()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _without(text: bytes, gone: np.ndarray) -> tuple[str, str]:
    """Digest of the kept words joined by a space, and the text without the removed words and the spaces after them."""
    kept = b" ".join(compress(text.split(), (~gone).tolist()))
    parts, word = [], -1
    for m in PARTS.finditer(text):
        word += 1
        if not gone[word]:
            parts.append(m[0])
    return hashlib.sha256(kept).hexdigest(), (b"".join(parts)).decode()


def _routes(candidates: DataFrame, passages: DataFrame, window: int, gram: int, fan_out: int | None = None) -> DataFrame:
    """(passage, bucket): the buckets whose documents may hold a window of the passage."""
    places = cut(candidates.select("bucket", F.explode("hits").alias("g")).distinct())
    held = passages.select("passage", F.explode("grams").alias("g"))
    wide = held.groupBy("g").agg(F.count(F.lit(1)).alias("p")).join(places.groupBy("g").agg(F.count(F.lit(1)).alias("b")), "g")
    wide = cut(wide.where(F.col("p") * F.col("b") > (FAN_OUT if fan_out is None else fan_out)).select("g"))
    if wide.isEmpty():
        return held.join(places, "g").select("passage", "bucket").distinct()
    sent = held.join(wide, "g", "left_anti").join(places, "g").select("passage", "bucket")
    of_documents = candidates.select("k", F.explode("hits").alias("g")).join(wide, "g").groupBy("k").agg(F.collect_set("g").alias("hits"))
    # The windows' key is the bucket of their document.
    texts = candidates.select("k", F.col("bucket").cast("long").alias("b"), "text").join(of_documents, "k").select(F.col("b").alias("k"), "text", "hits")
    there = texts.mapInArrow(ta.released(_windows, window=window, gram=gram), "w long, k long").distinct()
    of_passages = held.join(wide, "g").groupBy("passage").agg(F.collect_set("g").alias("hits"))
    ours = passages.select("passage", "words").join(of_passages, "passage").mapInArrow(ta.released(_windows_of_passages, window=window, gram=gram), "w long, passage string")
    return sent.union(ours.join(there, "w").select("passage", F.col("k").cast("int").alias("bucket"))).distinct()


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE_WORDS) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, text): a summary of each row (k: the id or the least long, id, n_words, text_sha, kept_sha: digest
    of all words joined by a space), and for each document that loses words (k, text_sha) its n_removed, kept_sha256
    and kept_text."""
    small_batches(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("k"), F.col("doc_id").cast("long").alias("id"), "text")
    summary = cut(keyed.mapInArrow(ta.released(_summaries, window=window, gram=gram), "k long, id long, n_words long, text_sha string, kept_sha string, grams array<long>"))
    grams = summary.select("k", F.explode("grams").alias("g"))
    shared = grams.groupBy("g").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").select("g")
    hits = grams.join(shared, "g").groupBy("k").agg(F.collect_set("g").alias("hits"), F.min("g").alias("least"))
    # Documents with the same least recurring gram are likely to share passages: they go to one bucket, or to several if
    # they are many.
    crowds = hits.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("salts"))
    hits = hits.join(crowds, "least").select("k", "hits", F.xxhash64("least", F.pmod(F.xxhash64("k"), F.col("salts"))).alias("place"))
    candidates = cut(keyed.join(hits, "k").select("k", "text", "hits", "place"))

    windows = candidates.mapInArrow(ta.released(_windows, window=window, gram=gram), "w long, k long")
    owned = windows.groupBy("w").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").groupBy(F.col("a").alias("k")).agg(F.collect_list("w").alias("owned"))
    passages = candidates.select("k", "text").join(owned, "k").mapInArrow(ta.released(_passages, window=window, gram=gram, piece=piece), "owner long, words binary, grams array<long>, passage string")
    passages = cut(passages.dropDuplicates(["passage"]))

    buckets = max(8, -(-(candidates.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    bucket = F.pmod("place", F.lit(buckets)).alias("bucket")
    sent = _routes(candidates.select("k", "text", "hits", bucket), passages, window, gram)
    sent = sent.join(passages.select("passage", "owner", "words"), "passage").select("bucket", "owner", "words")
    streamed = candidates.select(bucket, "k", "text").groupBy("bucket").cogroup(sent.groupBy("bucket"))
    streamed = streamed.applyInArrow(lambda a, b: _stream(a, b, window), "k long, text_sha string, n_removed long, kept_sha256 string, kept_text string")
    return summary.drop("grams"), streamed.dropDuplicates(["k", "text_sha"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE_WORDS) -> DataFrame:
    """For each document doc_id, n_words, n_removed and kept_sha256 (the kept words joined by one space)."""
    summary, lost = removals(docs, window, gram, piece)
    out = summary.join(lost.drop("kept_text"), ["k", "text_sha"], "left")
    return out.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "kept_sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages taken out of their texts; a document stays even if nothing of its text does."""
    _, lost = removals(docs.select("doc_id", "text"), window)
    lost = lost.select(F.col("k").alias("__k"), F.col("text_sha").alias("__sha"), F.col("kept_text").alias("__text"))
    keyed = docs.withColumns({"__k2": F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)), "__sha2": F.sha2("text", 256)})
    out = keyed.join(lost, (F.col("__k") == F.col("__k2")) & (F.col("__sha") == F.col("__sha2")), "left").withColumn("text", F.coalesce("__text", "text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out.select(docs.columns)
