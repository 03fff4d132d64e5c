"""Loci of canons and the quotations beside them: extraction, overlap, matches with disclosed changes, verdicts."""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import checks, reconcile
from corpusloom.operators.text import let

#: What may stand between a name and its number, a number, a range's end, a locus without a book.
GAP, NUMBER, RANGE = r"(?:\*{1,2}|_)?\s+", r"(\d+|[IVXL]+)", r"(?:\s*[-–—]\s*(\d+))?"
BARE = r"\((\d{1,3}):(\d{1,3})(?:\s*[-–—]\s*(\d{1,3}))?\)"
ELLIPSIS = r"\s*(?:\.\.\.|…)\s*"
LEAST_SCORE, LEAST_RUN, SUSPECT = 0.25, 4, 0.6


@dataclass
class Canon:
    """A canon's record: names of its sections (or prefixes, if sections are numbers), aliases, and how loci are written."""

    slug: str
    sections: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    separator: str = ":"
    depth: int = 3
    section_count: int | None = None

    def names(self) -> list[str]:
        return sorted({*self.sections, *self.aliases} if self.sections else {*self.prefixes}, key=len, reverse=True)

    def pattern(self) -> str:
        head, sep = "|".join(re.escape(n) for n in self.names()), re.escape(self.separator)
        tail = f"{GAP}{NUMBER}(?:{sep}(\\d+){RANGE})?" if self.depth == 2 else f"{GAP}{NUMBER}{sep}(\\d+){RANGE}"
        return rf"\b({head}){tail}"

    def section(self, name: Column) -> Column:
        for alias, own in self.aliases.items():
            name = F.when(name == alias, own).otherwise(name)
        return name


def _places(text: Column, pattern: str) -> Column:
    """(at, found) of each match of a pattern."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    before = lambda a, k: F.aggregate(F.slice(a, 1, k), F.lit(0), lambda n, s: n + F.length(s))
    return F.transform(hits, lambda h, i: F.struct((before(between, i + 1) + before(hits, i)).alias("at"), h.alias("found")))


def _number(digits: Column) -> Column:
    return F.when(digits.rlike(r"\A\d+\z"), digits.try_cast("int")).otherwise(norm.roman(digits))


def loci(texts: DataFrame, canon: Canon, key: str, chapters: DataFrame | None = None) -> DataFrame:
    """PJ35, JN6: (key, at, section, chapter, verse, hi) of texts (key, text): each locus that is written with a name, in roman or
    arabic numbers, with the end of a cited range; a canon of numbered sections has its slug for a section, and a section of its
    own without a verse has verse 0. `(c:v)` without a name takes the last name before it whose section has that chapter
    (chapters: section, chapter), in texts that name a locus. Of a repeated locus the first counts, with the furthest end."""
    pattern = canon.pattern()
    found = texts.select(key, F.explode(_places(F.col("text"), pattern)).alias("x"))
    part = lambda i: F.regexp_extract("x.found", pattern, i)
    verse = F.when(part(3) != "", part(3).try_cast("int")).otherwise(0)
    section = canon.section(part(1)) if canon.sections else F.lit(canon.slug)
    named = found.select(key, F.col("x.at").alias("at"), section.alias("section"), _number(part(2)).alias("chapter"), verse.alias("verse"), F.when(part(4) != "", part(4).try_cast("int")).otherwise(verse).alias("hi"))
    if not canon.sections and canon.section_count:
        named = named.where(F.col("chapter").between(1, canon.section_count))
    if canon.sections and chapters is not None:
        naming = texts.join(named.select(key).distinct(), key, "left_semi")
        bare = naming.select(key, F.explode(_places(F.col("text"), BARE)).alias("x"))
        bare = bare.select(key, F.col("x.at").alias("at"), *(F.regexp_extract("x.found", BARE, i).try_cast("int").alias(n) for i, n in ((1, "chapter"), (2, "verse"), (3, "hi"))))
        words = rf"\b({'|'.join(re.escape(n) for n in canon.names())})\b"
        mentions = naming.select(key, F.explode(_places(F.col("text"), words)).alias("x")).select(key, "x.at", canon.section(F.col("x.found")).alias("section"))
        implied = checks.implied_loci(bare.select(key, "at", "chapter", "verse"), mentions, chapters, key).join(bare, [key, "at", "chapter", "verse"])
        named = named.unionByName(implied.select(key, "at", "section", "chapter", "verse", F.coalesce("hi", "verse").alias("hi")))
    return named.groupBy(key, "section", "chapter", "verse").agg(F.min("at").alias("at"), F.max("hi").alias("hi"))


def overlap(span: Column, canon: Column) -> Column:
    """FZ8: (score, run): the longest run of a normalized span's words that a normalized text holds, and its share of the span."""

    def of(words: Column, canon: Column) -> Column:
        n = F.size(words)
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda i: F.array_max(F.filter(F.sequence(F.lit(0), n - i + 1), lambda k: (k == 0) | F.contains(canon, F.array_join(F.slice(words, i, k), " ")))))
        best = F.coalesce(F.array_max(runs), F.lit(0))
        return F.struct(F.when(n > 0, best / n).otherwise(0.0).alias("score"), best.alias("run"))

    words = F.filter(F.split(span, " "), lambda w: w != "")
    return let(F.struct(words.alias("w"), F.coalesce(canon, F.lit("")).alias("c")), lambda x: of(x["w"], x["c"]))


#: What a quotation has in brackets stands for up to so many characters of the source.
DISCLOSED = r"[\w' ]{0,24}"


def _folded(text: Column) -> Column:
    """Decomposed, with straight quotes: what comes before a text is cut into fragments."""
    return norm.flat_quotes(norm.decomposed(norm.flat_quotes(text), keep_marks=True))


def _plain(text: Column) -> Column:
    """N6 of a folded text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(text, "[]", "")), "[^a-z0-9' ]+", " "), " +", " "))


def fragment_pattern(part: Column) -> Column:
    """A fragment as a pattern: its words, and what it has in brackets as disclosed characters, with or without spaces between."""
    pieces = F.split(F.regexp_replace(part, r"\[[^\]]*\]", "\x01"), "\x01")
    listed = F.transform(pieces, lambda p, i: F.array(F.when(i > 0, DISCLOSED), F.when(_plain(p) != "", _plain(p))))
    return F.array_join(F.array_compact(F.flatten(listed)), r"\s*")


def match(quote: Column, canon: Column) -> Column:
    """FZ6 as (ok, detail): whether a quotation's fragments follow each other in a normalized text, by a fold over them. Where one is not
    found: up to six words before the divergence, or `not found`. Nulls are empty texts."""

    def of(x: Column) -> Column:
        parts = F.filter(F.split(x["q"], ELLIPSIS), lambda p: _plain(p) != "")

        def step(done: Column, part: Column) -> Column:
            rest = F.substring(x["c"], done["at"] + 1, F.length(x["c"]))
            at = F.regexp_instr(rest, fragment_pattern(part))
            size = F.length(F.call_function("regexp_extract", rest, fragment_pattern(part), F.lit(0)))
            return F.when(done["lost"].isNotNull(), done).when(at == 0, F.struct(done["at"].alias("at"), part.alias("lost"))).otherwise(F.struct((done["at"] + at - 1 + size).alias("at"), done["lost"].alias("lost")))

        lost = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("lost")), step, lambda done: done["lost"])

        def said(y: Column) -> Column:
            words = F.split(_plain(y["lost"]), " ")
            held = F.get(F.filter(F.reverse(F.sequence(F.lit(0), F.size(words))), lambda n: (n > 2) & F.contains(x["c"], F.array_join(F.slice(words, F.lit(1), n), " "))), F.lit(0))
            start = F.greatest(held - 6, F.lit(0))
            diverges = F.when(held.isNotNull(), F.concat(F.lit("diverges after "), F.array_join(F.slice(words, start + 1, held - start), " "))).otherwise("not found")
            whole = F.when((F.size(parts) == 1) & (_plain(x["q"]) == x["c"]), "whole").otherwise(F.concat(F.size(parts).cast("string"), F.lit(" in order")))
            return F.struct(y["lost"].isNull().alias("ok"), F.when(y["lost"].isNull(), whole).otherwise(diverges).alias("detail"))

        return let(F.struct(lost.alias("lost")), said)

    return let(F.struct(F.coalesce(_folded(quote), F.lit("")).alias("q"), F.coalesce(canon, F.lit("")).alias("c")), of)


def locus_verdicts(spans: DataFrame, found: DataFrame, verses: DataFrame, key: str, reach: int = 4) -> DataFrame:
    """FZ7: (key, no, span, status, section, chapter, verse, detail) of spans (key, no, span) beside loci (key, section, chapter, verse,
    hi), against verses (section, chapter, verse, text). A span is compared with the locus that it overlaps most; one of which
    less than a quarter or fewer than four words are there is `skipped`. Then MATCH; MATCH if every sentence of four words or
    more matches some locus of its unit; RANGE if verses around the locus match; SUSPECT below 0.6; else DRIFT. A locus that the
    index lacks is NOT IN INDEX (with no span). Units of several thousand spans are compared within the unit only."""
    known = found.join(verses.select("section", "chapter", "verse").distinct(), ["section", "chapter", "verse"], "left_semi")
    absent = found.join(verses, ["section", "chapter", "verse"], "left_anti").select(key, F.lit(None).cast("int").alias("no"), F.lit(None).cast("string").alias("span"), F.lit("NOT IN INDEX").alias("status"), "section", "chapter", "verse", F.lit("").alias("detail"))
    cited = reconcile.in_range(known.select(F.struct("section", "chapter", "verse", "hi").alias("locus"), "section", "chapter", F.col("verse").alias("lo"), "hi").distinct(), verses, ["section", "chapter"])
    cited = cited.select("locus.section", "locus.chapter", "locus.verse", "locus.hi", norm.verse_text(F.col("text")).alias("canon"))
    pairs = spans.join(known, key).join(cited, ["section", "chapter", "verse", "hi"])
    pairs = pairs.withColumn("x", overlap(norm.verse_text(F.col("span")), F.col("canon")))
    rank = F.row_number().over(Window.partitionBy(key, "no").orderBy(F.desc("x.score"), F.desc("x.run"), "at", "section", "chapter", "verse"))
    best = pairs.withColumn("__r", rank).where("__r = 1").drop("__r")
    judged = (F.col("x.score") >= LEAST_SCORE) & (F.col("x.run") >= LEAST_RUN)
    best = best.withColumn("m", match(F.col("span"), F.col("canon")))

    # Every sentence against every locus of the unit.
    words = lambda s: F.size(F.filter(F.split(norm.verse_text(s), " "), lambda w: w != ""))
    open_ = best.where(judged & ~F.col("m.ok"))
    sentences = open_.select(key, "no", F.posexplode(F.split("span", r"(?<=[.?!])\s+")).alias("s", "sentence")).where(words(F.col("sentence")) >= LEAST_RUN)
    tried = sentences.join(known, key).join(cited, ["section", "chapter", "verse", "hi"]).withColumn("ok", match(F.col("sentence"), F.col("canon"))["ok"])
    composite = tried.groupBy(key, "no", "s").agg(F.bool_or("ok").alias("ok")).groupBy(key, "no").agg((F.every("ok") & (F.count(F.lit(1)) > 1)).alias("composite"))

    # Ranges around the locus, in the order in which they are tried; every verse between must be there.
    # A locus' verses are fetched once, by their buckets, and its ranges are parts of them.
    near = open_.select("section", "chapter", "verse").distinct().withColumns({"lo": F.greatest(F.col("verse") - reach, F.lit(0)), "hi": F.col("verse") + reach})
    near = reconcile.verses_in(near, verses, ["section", "chapter"]).groupBy("section", "chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("__v", "__t"))).alias("around"))
    held = open_.join(near, ["section", "chapter", "verse"])
    held = held.select(key, "no", "span", "section", "chapter", "verse", "around", F.explode(F.sequence(F.col("verse"), F.greatest(F.col("verse") - reach, F.lit(0)), F.lit(-1))).alias("lo"))
    held = held.select("*", F.explode(F.sequence(F.col("verse"), F.col("verse") + reach)).alias("to")).where("NOT (lo = verse AND to = verse)")
    held = held.withColumn("range", F.filter("around", lambda v: v["__v"].between(F.col("lo"), F.col("to"))))
    # Both ends of a range are verses of the index.
    held = held.where((F.size("range") > 0) & (F.get("range", F.lit(0))["__v"] == F.col("lo")) & (F.element_at("range", -1)["__v"] == F.col("to")))
    held = held.where(match(F.col("span"), norm.verse_text(F.array_join(F.transform("range", lambda v: v["__t"]), " ")))["ok"])
    wider = held.groupBy(key, "no").agg(F.min(F.struct((-F.col("lo")).alias("l"), "to")).alias("r")).select(key, "no", F.concat((-F.col("r.l")).cast("string"), F.lit("-"), F.col("r.to").cast("string")).alias("range"))
    out = best.join(composite, [key, "no"], "left").join(wider, [key, "no"], "left")
    status = F.when(~judged, "skipped").when(F.col("m.ok") | F.coalesce("composite", F.lit(False)), "MATCH").when(F.col("range").isNotNull(), "RANGE").when(F.col("x.score") < SUSPECT, "SUSPECT").otherwise("DRIFT")
    detail = F.when(status == "RANGE", F.col("range")).when(status.isin("skipped", "SUSPECT"), "").when(F.col("m.ok") | (status == "DRIFT"), F.col("m.detail")).otherwise("composite")
    return out.select(key, "no", "span", status.alias("status"), "section", "chapter", "verse", detail.alias("detail")).unionByName(absent)


def is_scripture(span: Column, stream: Column, least: int = 4) -> Column:
    """FZ14: whether the fragments of a span that have four words or more, of which there is one, are all in a normalized stream;
    ellipses and words in brackets part them."""
    parts = F.transform(F.split(span, r"\s*(?:\.\.\.|…)\s*|\[[^\]]*\]"), lambda p: norm.source_text(p, ascii_only=True))
    long = F.filter(parts, lambda p: F.size(F.filter(F.split(p, " "), lambda w: w != "")) >= least)
    return (F.size(long) > 0) & F.forall(long, lambda p: F.contains(stream, p))
