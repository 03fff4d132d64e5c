"""Document fingerprints: SpotSigs.

A spot is a common word and the chain of the next content words after it (common words in between are skipped). The set of a
document's spots, hashed, is its fingerprint; two fingerprints are as alike as their sets (Jaccard). Sets are partitioned by
length: two sets whose lengths' ratio is below a floor cannot be as alike as it, and are not intersected.

spot_matches() searches: which documents are alike to a set of queries by a floor or more. Signatures meet in partitions by
length band, each in its own and the next, and there by the spots of their prefixes in one order of all spots, rare ones
first; lengths are compared again before sets are intersected. It is exact.

spot_signatures() compares each document with its edited text and with the next document, and reports the exact likeness of each pair;
with a floor, pairs whose lengths rule it out have a likeness of 0 without an intersection. A fingerprint holds all spots
of its text (eight digits for each, about three tenths of the text's length), so likeness is that of whole texts.

Words are runs of characters other than spaces, in lower case, without the punctuation marks of MARKS. A text without a
spot is its own only signature (the hash of its words), so short texts are told apart too. Everything is DataFrame functions
within a row; texts are put next to the document that follows them by buckets of doc_id with explicit bounds, so that only
bucket heads cross buckets. The number of buckets grows with the documents: ranges between quantiles of the ids, and equal
parts of each; null ids are parted by their texts' hashes.

Nulls and ties: a null text is empty; an empty text has the empty fingerprint. Two empty fingerprints are alike by 1, an empty
and another by 0. Null ids come last in the descending order; rows with equal ids are ordered by their texts' hash and share a
bucket, which may spill. A single row follows itself. An empty table gives an empty result; other columns are ignored."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish prose.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das den der des die ein eine ist mit nicht und von zu "
    "au dans est et la le les pour que qui sur un une "
    "con de del el en los para por se y"
).split()
CHAIN = 2
MARKS = '.,;:!?"()'
#: Ranges of ids between quantiles, at most, and rows in a bucket, about.
RANGES = 2048
BUCKET_ROWS = 4096
SIMILAR = 0.75


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for the row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spots(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct hashes of a text's spots; one hash if it has none, and none if it has no words."""
    plain = F.translate(F.lower(text), "\n\t\r\x0b\x0c\x01" + MARKS, " " * 6)
    marked = F.regexp_replace(plain, "(?<![^ ])(?:" + "|".join(sorted(ANCHORS, key=len, reverse=True)) + ")(?![^ ])", "\x01$0")
    words = F.filter(F.split(marked, " "), lambda w: w != "")

    def of_words(words: Column) -> Column:
        content = F.filter(words, lambda w: ~w.startswith("\x01"))
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).startswith("\x01"))

        def of_both(both: Column) -> Column:
            # The j-th common word, at position i, has i - j content words before it.
            found = F.transform(F.filter(F.transform(both["at"], lambda i, j: F.struct(i.alias("i"), (i - j).alias("k"))), lambda x: x["k"] + chain <= F.size(both["content"])), lambda x: F.hash(F.get(words, x["i"]), *(F.get(both["content"], x["k"] + n) for n in range(chain))))
            return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array(F.hash(F.array_join(words, " "))))

        return F.when(F.size(words) > 0, _let(F.struct(content.alias("content"), at.alias("at")), of_both)).otherwise(F.array().cast("array<int>"))

    return _let(words, of_words)


def as_text(fingerprint: Column) -> Column:
    """The hashes as hexadecimal digits, eight for each."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without intersecting them if their lengths bound it below `floor`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    return F.when(large == 0, 1.0).when((small == 0) | (small < large * floor), 0.0).otherwise(exact)


def length_band(fingerprint: Column, floor: float) -> Column:
    """Sets of bands that are not neighbours are alike by less than `floor`."""
    return F.when(F.size(fingerprint) > 0, F.floor(F.log(F.size(fingerprint).cast("double")) / F.log(F.lit(1 / floor)))).cast("int")


def _bucket(rows: DataFrame, id_col: str) -> Column:
    """The bucket of each row's id; buckets count from the greatest ids, those of null ids last."""
    least, greatest, known, total = rows.agg(F.min(id_col), F.max(id_col), F.count(id_col), F.count(F.lit(1))).first()
    wanted = max(1, min(RANGES, -(-known // BUCKET_ROWS)))
    cuts = rows.agg(F.percentile_approx(id_col, [i / wanted for i in range(1, wanted)], 100_000)).first()[0] if wanted > 1 else []
    bounds = sorted({int(b) for b in cuts or []}, reverse=True)
    id_ = F.col(id_col)
    if bounds:
        # The range is the number of bounds above the id, found among every 64th first.
        every = F.array(*[F.lit(b) for b in bounds])
        heads = F.array(*[F.lit(b) for b in bounds[::64]])
        block = F.greatest(F.size(F.filter(heads, lambda b: b > id_)) - 1, F.lit(0))
        range_ = block * 64 + F.size(F.filter(F.slice(every, block * 64 + 1, F.lit(64)), lambda b: b > id_))
    else:
        range_ = F.lit(0)
    parts = max(1, -(-known // (BUCKET_ROWS * (len(bounds) + 1))))
    part = F.lit(0)
    if parts > 1:
        tops = F.array(*[F.lit(b) for b in [int(greatest), *bounds]])
        ends = F.array(*[F.lit(b) for b in [*bounds, int(least) - 1]])
        top, end = F.get(tops, range_), F.get(ends, range_)
        part = F.floor((top - id_) / (top - end + 1) * parts)
    unknown = max(1, -(-(total - known) // BUCKET_ROWS))
    of_null = F.floor((F.xxhash64("text").cast("double") / 2.0**64 + 0.5) * unknown)
    return F.when(id_.isNull(), F.lit((len(bounds) + 1) << 32) + of_null).otherwise(range_.cast("long") * (1 << 32) + part).cast("long")


def following(rows: DataFrame, id_col: str, order: list[Column], derive: dict[str, Column], columns: list[str]) -> DataFrame:
    """rows by descending id with the derived columns, each row with next_<column> of the row that follows; the first row
    follows the last."""
    keyed = rows.withColumn("__bucket", _bucket(rows, id_col)).withColumn("__order", F.struct((-F.col(id_col)).alias("i"), *order))
    firsts = keyed.groupBy("__bucket").agg(F.min("__order").alias("__least"))
    around = Window.orderBy("__bucket")  # a row for each bucket
    to = F.coalesce(F.lag("__bucket").over(around), F.max("__bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # One row for about BUCKET_ROWS documents.
    firsts = firsts.select(F.col("__bucket").alias("__b"), "__least", to.alias("__to"))
    heads = keyed.join(F.broadcast(firsts), (F.col("__bucket") == F.col("__b")) & F.col("__order").eqNullSafe(F.col("__least")))
    heads = heads.dropDuplicates(["__b"]).withColumn("__bucket", F.col("__to")).select(*keyed.columns).withColumn("__head", F.lit(1))
    every = keyed.withColumn("__head", F.lit(0)).unionByName(heads).withColumns(derive)
    within = Window.partitionBy("__bucket").orderBy("__head", "__order")
    return every.select("*", *(F.lead(c).over(within).alias(f"next_{c}") for c in columns)).where("__head = 0").drop("__bucket", "__order", "__head")


def edited(text: Column, other: Column) -> Column:
    """text with its last half (rounded down) replaced by as many first characters of other, or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def spot_signatures(docs: DataFrame, chain: int = CHAIN, floor: float = 0.0) -> DataFrame:
    """For each document doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = following(rows, "doc_id", [F.xxhash64("text").alias("h")], {"spots": spots(F.col("text"), chain)}, ["text", "spots"])
    rows = rows.select("doc_id", "text", "spots", "next_spots", edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = rows.withColumn("edited_spots", spots(F.col("edited"), chain))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("spots")).alias("fingerprint"),
        as_text(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots"), floor).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots"), floor).alias("near_next"),
    )


def _signed(docs: DataFrame, id_name: str, chain: int) -> DataFrame:
    """(id, set): the distinct fingerprints that are not empty, with a number for each set."""
    sets = docs.select(F.col("doc_id").cast("long").alias(id_name), spots(F.coalesce("text", F.lit("")), chain).alias("set"))
    return sets.where(F.size("set") > 0).withColumn("c", F.xxhash64("set"))


def _prefixes(sets: DataFrame, counts: DataFrame, floor: float, near: bool) -> DataFrame:
    """Of (c, set) the postings (c, n, band, spot): a set's spots in the order of counts, rare first, as far as a set that is
    alike must share one of them; in its own length band and, if `near`, in those next to it."""
    n = F.size("set")
    rows = sets.select("c", n.alias("n"), F.explode("set").alias("spot")).join(counts, "spot", "left")
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.coalesce("df", F.lit(0)), "spot"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * floor - 1e-9) + 1)
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / floor))).cast("int")
    bands = F.array(own - 1, own, own + 1) if near else F.array(own)
    return rows.select("c", "n", "spot", F.explode(bands).alias("band"))


def spot_matches(queries: DataFrame, docs: DataFrame, floor: float = SIMILAR, chain: int = CHAIN) -> DataFrame:
    """Of queries and docs (doc_id, text) each pair query_id, doc_id and likeness that are alike by `floor` or more, found by
    length bands, prefixes and pruned intersections. Equal sets are compared once. Empty texts match nothing; rows with null ids
    match like others."""
    ours, theirs = _signed(queries, "query_id", chain), _signed(docs, "doc_id", chain)
    own, other = ours.select("c", "set").dropDuplicates(["c"]), theirs.select("c", "set").dropDuplicates(["c"])
    # Spots that no query has come first in the order, the queries' by how many sets have them.
    wanted = own.select(F.explode("set").alias("spot")).distinct()
    counts = other.select(F.explode("set").alias("spot")).join(wanted, "spot", "left_semi").groupBy("spot").agg(F.count(F.lit(1)).alias("df"))
    a = _prefixes(own, counts, floor, True).select(F.col("c").alias("a"), F.col("n").alias("n_a"), "spot", "band")
    b = _prefixes(other, counts, floor, False).select(F.col("c").alias("b"), F.col("n").alias("n_b"), "spot", "band")
    met = a.join(b, ["spot", "band"]).where((F.col("n_a") >= floor * F.col("n_b")) & (F.col("n_b") >= floor * F.col("n_a"))).select("a", "b").distinct()
    met = met.join(own.select(F.col("c").alias("a"), F.col("set").alias("set_a")), "a").join(other.select(F.col("c").alias("b"), F.col("set").alias("set_b")), "b")
    alike = met.select("a", "b", likeness(F.col("set_a"), F.col("set_b"), floor).alias("likeness")).where(F.col("likeness") >= floor)
    return alike.join(ours.select(F.col("c").alias("a"), "query_id"), "a").join(theirs.select(F.col("c").alias("b"), "doc_id"), "b").select("query_id", "doc_id", "likeness")
