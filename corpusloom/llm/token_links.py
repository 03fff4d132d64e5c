"""Links between the tokens of two tokenizers over the same bytes: posexplode, windowed lengths, an equi-join on ends.

A byte-level BPE (A) and a piece BPE with byte fallback (B) cut a space and the text into tokens. Offsets where tokens of both
end cut them into groups, and two tokens that end together are linked. Links are counted corpus-wide by their pair of ids.

Neither tokenizer has a token that runs from a character that is no white space into a space: A's pattern ends there, and B has
no such piece (checked when the model is loaded). So a text falls into segments, each a run of spaces and what follows up to the
next such place, whose tokens, ends and links are the same wherever they stand. `vocabulary` has each distinct segment
once with the number of its places; all the relational work is done there, per segment instead of per place:

    ends        posexplode of a segment's tokens; a windowed sum of their lengths gives their ends
    groups      tokens of A and B meet by an equi-join on segment and end; a running count of the cuts is the group
    pair_counts links grouped by ids, weighted with the segment's places; each B id's highest count
    stats       of each segment, its links joined with their counts, and its groups in writing

A document is the sum of its segments. Documents lie in parts of so many neighbours; a part's distinct segments fetch
what is known of them, so that a frequent segment is a row of each part, not of each place, and no key is hot. Then documents
and that share of the vocabulary meet by part, in a cogroup of 2**PART_BITS documents, where each document's numbers are added
and its groups joined in writing.

Nulls and ties: a null or empty text, or one whose tokens' bytes differ from a space and the text, as with U+2581, has no tokens:
zeros and an empty groups_sha256. Repeated rows count as often as they stand. An empty table gives an empty result; other columns are
ignored. Texts without spaces are one segment. `docs` is read twice and must be in the same order then, as a table of files is;
a row that doesn't find its segments there raises an error."""

import hashlib
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta
from corpusloom.llm.scratch import cut, discard, settings, small_batches, tidy

#: Where a text is cut into segments: before spaces, behind what is no white space. None of it ends with a space but the last.
#: Written out, as Java and Python differ in what is white space to them.
SEEN = r"[^\x00-\x20\x7F-\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
PLACE = f"(?<={SEEN})(?= +{SEEN})"
_PLACE = re.compile(PLACE)
#: Segments that are handed to the tokenizers at once; bytes of segments that are counted, and of texts that are looked up, at once.
BATCH, HELD, TEXTS = 2048, 1 << 26, 1 << 22
#: Rows of a part, at most, as bits of monotonically_increasing_id: the higher ones number what a task reads.
PART_BITS = 13
SPACE = "▁"
WORDS = ["segment", "places", "same", "a", "size_a", "b", "size_b"]


@cache
def _loaded(byte_json: str, piece_model: str):
    """Both tokenizers with the bytes of each of their tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    a = Tokenizer.from_file(byte_json)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    # Byte-level entries write bytes that don't print as the code points from 256 on, in order.
    shown = sorted(pre_tokenizers.ByteLevel.alphabet())
    direct = [ord(c) for c in shown if ord(c) < 256]
    as_byte = {chr(x): x for x in direct} | dict(zip((c for c in shown if ord(c) > 255), sorted(set(range(256)) - set(direct)), strict=True))
    entries = a.get_vocab(with_added_tokens=True)
    of_a = [b""] * (max(entries.values()) + 1)
    for token, i in entries.items():
        of_a[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError("the model has pieces that run into a space: texts can't be cut there")
    of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode() for p in pieces]
    return a, b, of_a, of_b


def _plain(text: str) -> bool:
    """Whether every space of a text has something to see on both sides, so that segments are what is between spaces."""
    return not ("  " in text or "\n " in text or " \n" in text or text[0].isspace() or text[-1].isspace()) and text.replace("\n", "").isprintable()


def _cut(text: str) -> list[str]:
    """The segments of a text, each without its first space."""
    return text.split(" ") if _plain(text) else [s[1:] for s in _PLACE.split(" " + text)]


def _segments(texts: pa.Array) -> pa.ListArray:
    """The segments of each text: those of plain texts by Arrow, the others' by the pattern."""
    odd = [k for k, t in enumerate(texts) if not _plain(t.as_py())]
    found = pc.split_pattern(texts, " ")
    if not odd:
        return found
    taken = pa.array([_cut(texts[k].as_py()) for k in odd], found.type)
    order = np.arange(len(texts))
    order[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([found, taken]).take(pa.array(order))


def _counted(batches):
    """The segments of each part that a task reads with how often; those of a part of more than HELD bytes are counted by as many."""
    now, held, size = None, [], 0

    def out():
        if held:
            counts = pc.value_counts(pa.concat_arrays(held))
            for at in range(0, len(counts), BATCH * 16):
                some = counts.slice(at, BATCH * 16)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now, np.int64)), some.field("values"), some.field("counts")], ["part", "segment", "n"])

    for batch in batches:
        parts = batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for i, j in zip(edges, edges[1:], strict=False):
            if i == j:
                continue
            if now != parts[i] or size >= HELD:
                yield from out()
                now, held, size = int(parts[i]), [], 0
            held.append(_segments(batch.column("text").slice(i, j - i)).flatten())
            size += held[-1].nbytes
    yield from out()


def _lists(ids: list[list[int]], sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The ids and their sizes in bytes as Arrow lists."""
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids])
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(sizes[flat]))


def _tokens(batches, byte_json: str, piece_model: str):
    a, b, of_a, of_b = _loaded(byte_json, piece_model)
    size_a, size_b = (np.array([len(x) for x in of], np.int16) for of in (of_a, of_b))
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            texts = batch.column("segment").to_pylist()
            ids_a = [e.ids for e in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            ids_b = b.encode(texts, num_threads=1)  # it adds the space
            same = [b"".join(map(of_a.__getitem__, x)) == b" " + t.encode() == b"".join(map(of_b.__getitem__, y)) for t, x, y in zip(texts, ids_a, ids_b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("places"), pa.array(same), *_lists(ids_a, size_a), *_lists(ids_b, size_b)], WORDS)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, part, doc_id, text): a part is read by one task."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("row", F.shiftright("row", PART_BITS).alias("part"), "doc_id", "text")


def readable() -> Column:
    return F.coalesce((F.col("text") != "") & ~F.contains("text", F.lit(SPACE)), F.lit(False))


def vocabulary(places: DataFrame, byte_json: str, piece_model: str) -> DataFrame:
    """Of rows (segment, n): each distinct segment with its places, ids and sizes of its tokens of A and B, whether their bytes
    are the segment's, and a number."""
    counted = places.groupBy("segment").agg(F.sum("n").alias("places"))
    lists = "a array<int>, size_a array<smallint>, b array<int>, size_b array<smallint>"
    read = counted.mapInArrow(ta.released(_tokens, byte_json=byte_json, piece_model=piece_model), f"segment string, places long, same boolean, {lists}")
    return read.withColumn("sid", F.monotonically_increasing_id())


def ends(words: DataFrame, side: str) -> DataFrame:
    """(sid, end, id): where each token of one side ends in its segment, in bytes."""
    tokens = words.select("sid", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"size_{side}").alias("size"))).alias("pos", "token"))
    end = F.sum("token.size").over(Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return tokens.select("sid", end.alias("end"), F.col("token.id").alias(side))


def groups(words: DataFrame) -> DataFrame:
    """Of a vocabulary each segment's groups as a1,a2|b1;a3|b2,b3 (`ids`), its numbers of tokens and groups, and its links: the
    tokens that a group ends with, which end together. Tokens of both sides meet by an equi-join on segment and end; the cuts
    before an end are its group."""
    by = words.drop("same").repartition("sid")
    met = ends(by, "a").join(ends(by, "b"), ["sid", "end"], "full")
    linked = F.col("a").isNotNull() & F.col("b").isNotNull()
    before = Window.partitionBy("sid").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    rows = met.withColumn("grp", F.count(F.when(linked, 1)).over(before))

    def in_order(c: str) -> Column:
        found = F.collect_list(F.when(F.col(c).isNotNull(), F.struct("end", c)))
        return F.when(F.size(found) == 1, found[0][c].cast("string")).otherwise(F.array_join(F.transform(F.array_sort(found), lambda x: x[c].cast("string")), ","))

    each = rows.groupBy("sid", "grp").agg(F.concat_ws("|", in_order("a"), in_order("b")).alias("ids"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.max(F.when(linked, F.struct("a", "b"))).alias("link"))
    whole = each.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("grp", "ids", "link"))).alias("all"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count(F.lit(1)).alias("n_groups"))
    out = whole.select("sid", F.array_join("all.ids", ";").alias("ids"), "n_a", "n_b", "n_groups", F.filter("all.link", lambda x: x.isNotNull()).alias("links"))
    return by.select("sid", "segment", "places").join(out, "sid")


def pair_counts(links: DataFrame) -> DataFrame:
    """Of links (places, a, b): each pair of ids, how many links corpus-wide hold it, and whether no pair of its B id has more."""
    counts = links.groupBy("a", "b").agg(F.sum("places").alias("pair_count"))
    return counts.withColumn("best", F.col("pair_count") == F.max("pair_count").over(Window.partitionBy("b")))


def stats(grouped: DataFrame) -> DataFrame:
    """Each segment with its groups in writing and its numbers of tokens, groups, links, best links and its sum of counts."""
    counts = pair_counts(grouped.select("places", F.explode("links").alias("x")).select("places", "x.a", "x.b"))
    counted = grouped.select("sid", F.inline("links")).join(counts, ["a", "b"])
    sums = counted.groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"), F.count_if("best").alias("n_best"), F.sum("pair_count").alias("count_sum"))
    return grouped.select("sid", "segment", "ids", "n_a", "n_b", "n_groups").join(sums, "sid").drop("sid")


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _summed(docs: pa.Table, share: pa.Table) -> pa.Table:
    """The documents of a part: numbers of their segments added, groups in writing joined. Texts are read some at a time, and their
    segments found in the share, by Arrow."""
    known, ids = (pa.concat_arrays(share[c].chunks) if len(share) else pa.array([], pa.string()) for c in ("segment", "ids"))
    numbers = np.stack([share[c].to_numpy() for c in NUMBERS], axis=1)
    sums, digests = [np.zeros((0, len(NUMBERS)), np.int64)], []
    texts = pa.concat_arrays(docs["text"].chunks) if len(docs) else pa.array([], pa.string())
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXTS, "right")))
        found = _segments(texts.slice(at, to - at))
        which = pc.index_in(found.flatten(), value_set=known)
        if which.null_count:
            raise ValueError("documents were read in another order than before")
        first = found.offsets.to_numpy() - found.offsets[0].as_py()
        sums.append(np.add.reduceat(numbers[which.to_numpy()], first[:-1], axis=0))
        written = pc.binary_join(pa.ListArray.from_arrays(pa.array(first), ids.take(which)), pa.scalar(";"))
        digests += [hashlib.sha256(x.as_buffer()).hexdigest() for x in written]
        at = to
    columns = np.concatenate(sums)
    return pa.table([docs["doc_id"], *(pa.array(np.ascontiguousarray(c)) for c in columns.T), pa.array(digests, pa.string())], ["doc_id", *NUMBERS, "groups_sha256"])


def _by_part(docs: pa.Table, share: pa.Table) -> pa.Table:
    out = _summed(docs, share)
    pa.default_memory_pool().release_unused()
    return out


def by_document(docs: DataFrame, share: DataFrame) -> DataFrame:
    """Of numbered documents and what is known of their parts' segments (part, segment, ...): a row for each document. A part's
    documents, which one task has read, meet their segments there."""
    out = "doc_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups_sha256 string"
    return docs.groupBy("part").cogroup(share.groupBy("part")).applyInArrow(_by_part, out)


def _placed(batches):
    for batch in batches:
        found = [sorted(set(_cut(t.as_py()))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.string()))], ["row", "segments"])


def lost_rows(docs: DataFrame, odd: DataFrame) -> DataFrame:
    """The rows of documents that have one of the segments."""
    placed = docs.select("row", "text").mapInArrow(_placed, "row long, segments array<string>")
    return placed.select("row", F.explode("segments").alias("segment")).join(odd, "segment", "left_semi").select("row").distinct()


def token_links(docs: DataFrame, byte_json: str, piece_model: str) -> DataFrame:
    """For each document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = numbered(docs)
    good = rows.where(readable())

    def read(good: DataFrame) -> tuple[DataFrame, DataFrame]:
        held = cut(good.select("part", "text").mapInArrow(ta.released(_counted), "part long, segment string, n long"))
        return held, cut(vocabulary(held.select("segment", "n"), byte_json, piece_model))

    with tidy(spark):
        held, words = read(good)
        odd = words.where("NOT same").select("segment")
        bad = not odd.isEmpty()
        if bad:  # all documents that have one are left out, and what is left is counted again
            lost = cut(lost_rows(good, odd))
            good = good.join(lost, "row", "left_anti")
            discard(held, words)
            held, words = read(good)
        # Tables that are partitioned by some of a join's keys are joined as they are.
        with settings(spark, spark_sql_requireAllClusterKeysForCoPartition="false"):
            grouped = cut(groups(words))
        discard(words)
        known = cut(stats(grouped))
        discard(grouped)
        share = cut(held.select("part", "segment").join(known, "segment"))
        discard(held, known)
        out = cut(by_document(good, share))
        discard(share)
    none = rows.where(~readable())
    none = none.unionByName(rows.join(lost, "row", "left_semi")) if bad else none
    return out.unionByName(none.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in NUMBERS), F.lit("").alias("groups_sha256")))
