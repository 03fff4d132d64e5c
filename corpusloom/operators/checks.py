"""Checks of texts, captions, decks, loci and decisions: DataFrame in, DataFrame out."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import norm


def garbled(stream: Column, least: int = 12, share: float = 0.35) -> Column:
    """FL2: of at least so many words of a normalized stream, more than a share are of one or two letters or hold other
    characters than a-z and apostrophes. False for null and for fewer words. The share is a decimal: 49 of 140 words are not
    more than 0.35 of them."""
    words = F.filter(F.split(F.coalesce(stream, F.lit("")), " "), lambda w: w != "")
    junk = F.filter(words, lambda w: (F.length(w) <= 2) | ~w.rlike("^[a-z']+$"))
    return (F.size(words) >= least) & (F.size(junk) > F.lit(Decimal(str(share))) * F.size(words))


def not_found(url: Column, markers: list[str]) -> Column:
    """FL16: an address that holds any of the markers."""
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(url, m))


def content_presence(paragraphs: DataFrame, pages: DataFrame, key: str, least: int = 40) -> DataFrame:
    """FZ13: paragraphs (key, text) of at least so many characters that their page (key, page) lacks, white space aside. A
    document without a page lacks all of them; shorter paragraphs are not looked for."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    wanted = paragraphs.select(key, norm.page_text(F.col("text")).alias("want")).where(F.length("want") >= least)
    # A document's paragraphs meet its page in one row, so that the page moves once.
    wanted = wanted.groupBy(key).agg(F.collect_list(bare(F.col("want"))).alias("wants"))
    held = pages.select(key, bare(norm.page_text(F.col("page"))).alias("have"))
    lost = F.size(F.filter("wants", lambda w: ~F.coalesce(F.contains("have", w), F.lit(False))))
    return wanted.join(held, key, "left").select(key, F.size("wants").cast("long").alias("paragraphs"), lost.cast("long").alias("missing"))


def caption_findings(images: DataFrame, captions: DataFrame, urls: DataFrame, key: str) -> DataFrame:
    """FL11: images (key, src) without a caption, and captions (key, file, caption) of no image. An address is mapped back to
    its file by urls (key, url, file) first; an empty caption is none."""
    mapped = images.join(urls.select(key, F.col("url").alias("src"), F.col("file").alias("__f")), [key, "src"], "left").select(key, F.coalesce("__f", "src").alias("file")).distinct()
    missing = mapped.join(captions.where("trim(caption) <> ''").select(key, "file"), [key, "file"], "left_anti").withColumn("finding", F.lit("missing"))
    return missing.unionByName(captions.select(key, "file").join(mapped, [key, "file"], "left_anti").withColumn("finding", F.lit("orphan")))


def deck_compare(ours: DataFrame, theirs: DataFrame, deck: str, values: list[str]) -> DataFrame:
    """FZ18, JN17: slides (deck, n, key, values) of two decks. Slides meet by key if all of the other deck's have one, else by
    position; the faults are the names of the values that differ. A deck that the other side lacks is missing slide by slide."""
    keyed = theirs.groupBy(deck).agg(F.every(F.col("key").isNotNull()).alias("keyed"))
    tag = lambda df: df.join(keyed, deck, "left").withColumn("__at", F.when(F.coalesce("keyed", F.lit(True)), F.coalesce("key", F.col("n").cast("string"))).otherwise(F.col("n").cast("string")))
    a = tag(ours).select(deck, F.col("__at").alias("slide"), *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(True).alias("__a"))
    b = tag(theirs).select(deck, F.col("__at").alias("slide"), *[F.col(v).alias(f"__b_{v}") for v in values], F.lit(True).alias("__b"))
    faults = F.array_compact(F.array(*[F.when(~F.col(f"__a_{v}").eqNullSafe(F.col(f"__b_{v}")), v) for v in values]))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.size(faults) > 0, "drift").otherwise("match")
    out = a.join(b, [deck, "slide"], "full")
    return out.select(deck, "slide", status.alias("status"), F.when(status == "drift", F.array_join(faults, ",")).otherwise("").alias("faults"))


def resolved(states: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """XT3: the base of rows (keys, base, draft, live) after decisions (keys, take): `draft` makes live the base, so that the
    row is pushed; `live` makes the draft the base, so that it is pulled. Rows without a decision keep theirs."""
    out = states.join(decisions.select(*keys, "take"), keys, "left")
    base = F.when(F.col("take") == "draft", F.col("live")).when(F.col("take") == "live", F.col("draft")).otherwise(F.col("base"))
    return out.select(*keys, base.alias("base"), "draft", "live")


def lapsed(deferrals: DataFrame, drafts: DataFrame, key: str) -> DataFrame:
    """TM10: deferrals (key, sha) whose draft has changed or is gone."""
    return deferrals.join(drafts.select(key, "sha"), [key, "sha"], "left_anti").select(key)


def ordered_tags(used: DataFrame, vocabulary: DataFrame, owner: str) -> DataFrame:
    """ST2: each owner's tags (owner, tag, pos) in the vocabulary's order (tag, ord), unknown ones last in their own."""
    out = used.join(vocabulary.select("tag", "ord"), "tag", "left")
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(1 << 30)).alias("o"), "pos", "tag")))
    return out.groupBy(owner).agg(F.transform(rows, lambda r: r["tag"]).alias("tags"))


def implied_loci(bare: DataFrame, mentions: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """PJ35, JN6: the section of each bare locus (key, at, chapter, verse): the last one named before it (key, at, section)
    that has such a chapter (section, chapter). Loci without one are left out."""
    # An as-of join by key and chapter: each name stands for all chapters of its section, in the order of the text.
    named = mentions.join(chapters.select("section", "chapter").distinct(), "section").select(key, "chapter", "at", F.lit(None).cast("int").alias("verse"), F.lit(1).alias("__kind"), "section")
    asked = bare.select(key, "chapter", "at", "verse", F.lit(0).alias("__kind"), F.lit(None).cast("string").alias("section"))
    before = Window.partitionBy(key, "chapter").orderBy("at", "__kind").rowsBetween(Window.unboundedPreceding, -1)
    met = named.unionByName(asked).withColumn("section", F.when(F.col("__kind") == 0, F.last("section", ignorenulls=True).over(before)).otherwise(F.col("section")))
    return met.where("__kind = 0 AND section IS NOT NULL").select(key, "at", "chapter", "verse", "section").distinct()


def neighbour_ranges(loci: DataFrame, reach: int = 4) -> DataFrame:
    """JN9: ranges around a verse (locus, verse) to try, nearest start first, with the order in which they are tried."""
    lo = F.sequence(F.col("verse"), F.greatest(F.col("verse") - reach, F.lit(0)), F.lit(-1))
    pairs = loci.select("locus", "verse", F.explode(lo).alias("lo")).select("*", F.explode(F.sequence(F.col("verse"), F.col("verse") + reach)).alias("hi"))
    pairs = pairs.where("NOT (lo = verse AND hi = verse)")
    return pairs.withColumn("tried", F.row_number().over(Window.partitionBy("locus").orderBy(F.desc("lo"), "hi")))


def superseded(line: Column, words: list[str]) -> Column:
    """FL10: a line that says that it has been replaced."""
    return line.rlike(r"(?i)\b(" + "|".join(rf"\Q{w}\E" for w in words) + r")\b")


def source_aliases(shelf: DataFrame, stop: list[str]) -> DataFrame:
    """PJ34: how notes may name each source (source, work): (source, alias, weight). Italic titles of two words or more weigh
    100 and their first 4 or 3 words 80, bold names 60 and 50, words with a capital after the first dash or "tr." 40. A prefix
    needs a word of five letters that is not in `stop`; a surname is in neither `stop`, a title, nor a bold name but the last.
    A null or empty work has no aliases; of repeated aliases the greatest weight counts."""
    quiet = F.array(*[F.lit(w) for w in stop]).cast("array<string>")
    work = F.coalesce("work", F.lit(""))
    spans = {100: F.regexp_extract_all(work, F.lit(r"(?<!\*)\*(?!\*)([^*]{4,})\*(?!\*)"), F.lit(1)), 60: F.regexp_extract_all(work, F.lit(r"\*\*([^*]{4,})\*\*"), F.lit(1))}
    split = F.regexp_extract(work, r"(?s)^.*?(?:—|\btr\.\s)(.*)$", 1)
    author = F.regexp_replace(F.when(work.rlike(r"—|\btr\.\s"), split).otherwise(work), "[“\"][^”\"]{4,}[”\"]", " ")
    rows = shelf.select("source", spans[100].alias("titles"), spans[60].alias("bolds"), F.regexp_extract_all(author, F.lit(r"\b([A-Z][a-zA-Z'’-]{4,})\b"), F.lit(1)).alias("capital"))

    names = rows.select("source", F.explode("titles").alias("n"), F.lit(100).alias("weight")).union(rows.select("source", F.explode("bolds"), F.lit(60)))
    names = names.select("source", norm.source_text(F.col("n")).alias("alias"), "weight").withColumn("w", F.split("alias", " ")).where(F.size("w") >= 2)
    less = F.when(F.col("weight") == 100, 80).otherwise(50)
    cuts = names.select("source", less.alias("weight"), "w", F.explode(F.array(F.lit(4), F.lit(3))).alias("k")).where(F.size("w") > F.col("k"))
    cuts = cuts.select("source", F.slice("w", 1, F.col("k")).alias("w"), "weight").where(F.exists("w", lambda x: (F.length(x) >= 5) & ~F.array_contains(quiet, x)))

    taken = rows.select("source", F.explode(F.concat("titles", F.slice("bolds", 1, F.greatest(F.size("bolds") - 1, F.lit(0))))).alias("n"))
    taken = taken.select("source", F.explode(F.split(norm.source_text(F.col("n")), " ")).alias("alias")).distinct()
    surnames = rows.select("source", F.explode("capital").alias("n")).select("source", norm.source_text(F.col("n")).alias("alias"))
    surnames = surnames.where((F.col("alias") != "") & ~F.array_contains(quiet, F.col("alias"))).join(taken, ["source", "alias"], "left_anti")
    found = names.select("source", "alias", "weight").union(cuts.select("source", F.array_join("w", " "), "weight")).union(surnames.select("source", "alias", F.lit(40)))
    return found.groupBy("source", "alias").agg(F.max("weight").alias("weight"))
