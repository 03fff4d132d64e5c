"""Indexes built from source texts: numbered verses, chapters, pages, and manifests read from their lines.

Sources are frames (source, text) or (source, page, text); rows keep the order of the text. A null text gives no rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import text as t

#: The lines around an eBook's text, furniture wherever it stands, verse marks, chapter headings, note marks.
START, END = r"\*\*\* ?START OF TH[EIS]+ PROJECT GUTENBERG[^\n]*\n", r"\*\*\* ?END OF TH[EIS]+ PROJECT GUTENBERG"
FURNITURE = r"\b(?:https?://|www\.)[^\s]+|\bPage\s+\d+\b|\b\d+\s*\|\s*Page\b"
VERSE = r"(\d+):(\d+) "
BRACE = r"\{\s*(\d+)\s*:\s*(\d+)\s*\}"
CHAPTER = r"\A\s*CHAPTER\s+([IVXL]+)\s*\z"
NOTE_MARK, NOTES_BEGIN = r"\[FN#[^\]]{1,8}\]", r"(?m)^\[FN#"
TESTAMENT = r"(?i)\Athe (old|new) testament\b"
PRELOADS = r"(?s)window\._preloads\s*=\s*JSON\.parse\((\".*?\")\)\s*;?\s*</script>"


def enclosed(text: Column) -> Column:
    """SC9, SC11: what stands between the lines that begin and end an eBook; all of it where they are absent."""
    body = F.regexp_replace(text, rf"(?s)\A.*?{START}", "")
    return F.regexp_replace(body, rf"(?s){END}.*\z", "")


def cleaned(text: Column) -> Column:
    """A row's text without furniture, in its ingested form."""
    return norm.ingested(F.trim(norm.scrubbed(text, FURNITURE)))


def _lines(docs: DataFrame, body: Column) -> DataFrame:
    return docs.select("source", F.posexplode(F.split(body, "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))


def _verses(streams: DataFrame, mark: str) -> DataFrame:
    """Of (source, section, ord, stream) the rows (source, section, ord, chapter, verse, text) between marks; of a repeated key the first
    counts, and rows without text are left out."""
    parts = F.slice(F.split("stream", mark), 2, 1 << 30)
    marks = F.arrays_zip(F.regexp_extract_all("stream", F.lit(mark), F.lit(1)).alias("c"), F.regexp_extract_all("stream", F.lit(mark), F.lit(2)).alias("v"), parts.alias("t"))
    rows = streams.select("source", "section", "ord", F.posexplode(marks).alias("pos", "x"))
    rows = rows.select("source", "section", "ord", "pos", F.col("x.c").cast("int").alias("chapter"), F.col("x.v").cast("int").alias("verse"), cleaned(F.col("x.t")).alias("text")).where("text <> ''")
    first = F.row_number().over(Window.partitionBy("source", "section", "chapter", "verse").orderBy("ord", "pos"))
    return rows.withColumn("__r", first).where("__r = 1").drop("__r", "pos")


def titled_verses(docs: DataFrame, names: list[str] | None = None, errata: DataFrame | None = None) -> DataFrame:
    """SC9: (source, section, chapter, verse, text) of texts that print `C:V text` under titles. The lines before the first verse
    name the titles; a title opens a section only once the last one has a verse, so a title of several lines is one. Sections
    are called by `names` in order, or by their titles. errata: (section, chapter, verse, wrong, right)."""
    lines = _lines(docs, enclosed(F.col("text"))).where("line <> ''")
    # A mark alone on its line is a verse without text, not text of the verse before it.
    lines = lines.withColumn("line", F.when(F.col("line").rlike(r"\A\d+:\d+\z"), F.concat("line", F.lit(" "))).otherwise(F.col("line")))
    of_source = Window.partitionBy("source")
    lines = lines.withColumn("__v", F.col("line").rlike(rf"\A{VERSE}")).withColumn("__first", F.min(F.when(F.col("__v"), F.col("n"))).over(of_source))
    toc = lines.where((F.col("n") < F.col("__first")) & ~F.col("line").rlike(TESTAMENT)).select("source", "line", F.lit(True).alias("__title")).distinct()
    lines = lines.join(toc, ["source", "line"], "left").withColumn("__title", F.coalesce("__title", F.lit(False)))
    begin = F.max(F.when(F.col("__title") & (F.col("n") < F.col("__first")), F.col("n"))).over(of_source)
    lines = lines.withColumn("__begin", begin).where(F.col("n") >= F.col("__begin"))
    order = Window.partitionBy("source").orderBy("n")
    lines = lines.withColumn("__seen", F.sum(F.when(~F.col("__title") & F.col("line").rlike(VERSE), 1).otherwise(0)).over(order))
    # Verses up to the last title: a title opens a section if there were some since.
    before = F.last(F.when(F.col("__title"), F.col("__seen")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("__title") & (before.isNull() | (F.col("__seen") > before))
    lines = lines.withColumn("__opens", opens).withColumn("ord", F.sum(F.when(F.col("__opens"), 1).otherwise(0)).over(order))
    streams = lines.groupBy("source", "ord").agg(F.min_by("line", F.when(F.col("__opens"), F.col("n"))).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("__title"), F.struct("n", "line")))), lambda x: x["line"]), " ").alias("stream"))
    section = F.coalesce(F.get(F.array(*[F.lit(x) for x in names]), F.col("ord").cast("int") - 1), F.col("title")) if names else F.col("title")
    rows = _verses(streams.withColumn("section", section), VERSE)
    if errata is not None:
        fixes = errata.groupBy("section", "chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("wrong", "right"))).alias("__e"))
        rows = rows.join(fixes, ["section", "chapter", "verse"], "left")
        rows = rows.withColumn("text", F.coalesce(F.aggregate("__e", F.col("text"), lambda s, e: F.replace(s, e["wrong"], e["right"])), F.col("text")))
    return rows.select("source", "section", "ord", "chapter", "verse", "text")


def numbered_rows(docs: DataFrame) -> DataFrame:
    """SC10: (source, n, section, verse, text, unparsed) of lines `section|verse|text`; blank lines and remarks (#) are left out, lines
    of another form are kept as unparsed."""
    lines = docs.select("source", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).where("trim(line) <> '' AND NOT startswith(ltrim(line), '#')")
    form = r"\A\s*(\d+)\s*\|\s*(\d+)\s*\|(.*)\z"
    ok = F.col("line").rlike(form)
    number = lambda i: F.when(ok, F.regexp_extract("line", form, i).cast("int"))
    return lines.select("source", "n", number(1).alias("section"), number(2).alias("verse"), F.when(ok, cleaned(F.regexp_extract("line", form, 3))).alias("text"), F.when(~ok, F.col("line")).alias("unparsed"))


def contiguity(rows: DataFrame, sections: int | None = None) -> DataFrame:
    """XT17: (source, finding, section): sections that are not exactly 1 to n (`sections`, or the greatest), and sections whose
    verses are not 1 to n in the order of the file."""
    by = Window.partitionBy("source", "section").orderBy("n")
    broken = rows.where("text <> ''").withColumn("__r", F.row_number().over(by)).where("verse <> __r").select("source", F.lit("verses not contiguous").alias("finding"), "section").distinct()
    held = rows.where("text <> ''").groupBy("source").agg(F.collect_set("section").alias("s"), F.max("section").alias("m"))
    last = F.lit(sections) if sections is not None else F.col("m")
    want = F.sequence(F.lit(1), last)
    missing = held.select("source", F.lit("section missing").alias("finding"), F.explode(F.array_except(want, F.col("s"))).alias("section"))
    extra = held.select("source", F.lit("section unknown").alias("finding"), F.explode(F.array_except("s", want)).alias("section"))
    return broken.union(missing).union(extra)


def chapters(docs: DataFrame) -> DataFrame:
    """SC11: (source, ord, chapter, text) of texts in chapters with roman numbers; notes at the end and note marks are left out."""
    body = F.regexp_replace(enclosed(F.col("text")), rf"(?s){NOTES_BEGIN}.*\z", "")
    lines = docs.select("source", F.posexplode(F.split(body, "\r?\n")).alias("n", "line"))
    order = Window.partitionBy("source").orderBy("n")
    lines = lines.withColumn("__h", F.regexp_extract("line", CHAPTER, 1)).withColumn("ord", F.sum(F.when(F.col("__h") != "", 1).otherwise(0)).over(order)).where("ord > 0")
    rows = lines.groupBy("source", "ord").agg(F.max("__h").alias("__h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__h") == "", F.struct("n", "line")))), lambda x: x["line"]), " ").alias("text"))
    # As by cleaned(), in steps, so that each is made once for the row; a filter on the text would make it again.
    rows = rows.select("source", "ord", norm.roman(F.col("__h")).alias("chapter"), F.trim(norm.scrubbed(F.regexp_replace("text", NOTE_MARK, " "), FURNITURE)).alias("text"))
    made = F.filter(F.array(norm.ingested(F.col("text"))), lambda x: x != "")
    return rows.select("source", "ord", "chapter", F.explode(made).alias("text"))


def chapter_findings(rows: DataFrame, expected: int, times: int = 4) -> DataFrame:
    """SC11, AG12: (source, finding, chapter): chapters that are not exactly 1 to `expected` in order, and chapters longer than
    `times` the upper median. Texts are made once, and only their lengths are gathered by source."""
    held = rows.select("source", F.struct(F.length("text").alias("n"), "chapter", "ord").alias("x")).groupBy("source").agg(F.collect_list("x").alias("xs"))
    held = held.withColumn("median", F.get(F.array_sort(F.transform("xs", lambda x: x["n"])), F.floor(F.size("xs") / 2).cast("int")))
    found = lambda name, chapters: F.transform(chapters, lambda c: F.struct(F.lit(name).alias("finding"), c.alias("chapter")))
    chapter_of = lambda xs: F.transform(xs, lambda x: x["chapter"])
    fat = found("far longer than the median", chapter_of(F.filter("xs", lambda x: x["n"] > times * F.col("median"))))
    wrong = found("out of order", chapter_of(F.filter("xs", lambda x: x["chapter"] != x["ord"])))
    missing = found("missing", F.array_except(F.sequence(F.lit(1), F.lit(expected)), chapter_of(F.col("xs"))))
    return held.select("source", F.inline(F.concat(fat, wrong, missing)))


def pages(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """SC13: (source, page, text) of pages without what repeats on `share` of a source's pages or is furniture anywhere; pages
    without other text are left out."""
    found = t.furniture(docs, "source", "page", share=share)
    left = t.without_furniture(docs, found, "source", "page")
    return left.select("source", "page", cleaned(F.col("text")).alias("text")).where("text <> ''")


def marked_verses(docs: DataFrame, names: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """SC14: (source, section, ord, chapter, verse, text) of pages with marks `{C:V}`: a name of a section at a page's start opens
    it; pages before the first name, and pages without a mark, are left out. Names are tried longest first."""
    head = F.regexp_replace(F.regexp_replace(norm.scrubbed(F.col("text"), FURNITURE), r"\A\s+", ""), r"\APage\s+\d+\s*", "")
    every = sorted({*names, *(aliases or {})}, key=len, reverse=True)
    pattern = r"\A(" + "|".join(rf"\Q{x}\E" for x in every) + r")(?![a-z])"
    rows = docs.select("source", "page", head.alias("body")).withColumn("__h", F.regexp_extract("body", pattern, 1))
    called = F.col("__h")
    for alias, name in (aliases or {}).items():
        called = F.when(F.col("__h") == alias, name).otherwise(called)
    order = Window.partitionBy("source").orderBy("page")
    rows = rows.withColumn("section", F.last(F.when(F.col("__h") != "", called), ignorenulls=True).over(order))
    rows = rows.withColumn("body", F.when(F.col("__h") != "", F.substring(F.col("body"), F.length("__h") + 1, F.length("body"))).otherwise(F.col("body"))).where("section IS NOT NULL AND contains(body, '{')")
    streams = rows.groupBy("source", "section").agg(F.min("page").alias("ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), " ").alias("stream"))
    return _verses(streams, BRACE).select("source", "section", "ord", "chapter", "verse", "text")


def index_findings(rows: DataFrame, short: int = 200) -> DataFrame:
    """FL17: (source, finding, section, chapter) of index rows (source, n, section, chapter, verse, text). Rows without a verse are
    blocks, whose chapter numbers must ascend; rows of verse 0 are chapters, which must be exactly 1 to n, each once and not
    short; others must hold no gap within a chapter. Furniture in any text is a finding."""
    dirty = rows.where(F.col("text").rlike("(?i)" + FURNITURE)).select("source", F.lit("furniture").alias("finding"), "section", "chapter").distinct()
    order = Window.partitionBy("source").orderBy("n")
    blocks = rows.where("verse IS NULL").withColumn("__p", F.lag("chapter").over(order)).where("chapter IS NULL OR __p > chapter").select("source", F.lit("not ascending").alias("finding"), "section", "chapter")
    whole = rows.where("verse = 0")
    again = whole.groupBy("source", "section", "chapter").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("source", F.lit("repeated").alias("finding"), "section", "chapter")
    held = whole.groupBy("source", "section").agg(F.collect_set("chapter").alias("s"), F.max("chapter").alias("m")).where("m >= 1")
    lost = held.select("source", F.lit("missing").alias("finding"), "section", F.explode(F.array_except(F.sequence(F.lit(1), F.col("m")), F.col("s"))).alias("chapter"))
    brief = whole.where(F.length("text") < short).select("source", F.lit("short").alias("finding"), "section", "chapter")
    verses = rows.where("verse > 0").groupBy("source", "section", "chapter").agg(F.countDistinct("verse").alias("k"), F.max("verse").alias("m")).where("k < m").select("source", F.lit("gap").alias("finding"), "section", "chapter")
    return dirty.union(blocks).union(again).union(lost).union(brief).union(verses)


def embedded_post(html: Column) -> Column:
    """SC16: the post that a page carries as JSON within a script, as JSON; null if it has none."""
    quoted = F.regexp_extract(html, PRELOADS, 1)
    inner = F.get(F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(quoted != "", F.get_json_object(inner, "$.post"))


def manifest_lines(manifests: DataFrame) -> DataFrame:
    """SC5: (source, n, field, sub, value) of `key: value` lines and one nested level; remarks and lines of another form are left
    out, and a key without a value opens a block."""
    lines = manifests.select("source", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).withColumn("line", F.regexp_replace(F.substring_index("line", "#", 1), r"\s+\z", ""))
    lines = lines.where(F.contains("line", F.lit(":")) & (F.trim("line") != "")).withColumn("nested", F.col("line").rlike(r"\A[ \t]"))
    bare = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    name = bare(F.substring_index("line", ":", 1))
    value = bare(F.expr("substring(line, instr(line, ':') + 1)"))
    lines = lines.withColumns({"name": name, "value": value})
    opened = F.last(F.when(~F.col("nested"), F.when(F.col("value") == "", F.col("name")).otherwise("")), ignorenulls=True).over(Window.partitionBy("source").orderBy("n"))
    lines = lines.withColumn("block", F.coalesce(opened, F.lit("")))
    rows = lines.where("(nested AND block <> '') OR (NOT nested AND value <> '')")
    return rows.select("source", "n", F.when(F.col("nested"), F.col("block")).otherwise(F.col("name")).alias("field"), F.when(F.col("nested"), F.col("name")).alias("sub"), "value")


def repeated_keys(manifests: DataFrame) -> DataFrame:
    """SC6: (source, field, n) of top-level keys that a manifest states more than once, which is an error."""
    keys = manifests.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^([A-Za-z_][\w-]*)\s*:"), F.lit(1))).alias("field"))
    return keys.groupBy("source", "field").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def parsed_yaml(text: Column) -> Column:
    """SC4: a whole YAML manifest as JSON ({} for an empty one, null for one that cannot be read). Needs the yaml package, in Arrow
    batches; manifest_lines() does without it."""
    import json

    import pandas as pd
    import yaml

    @F.pandas_udf("string")
    def read(raw: pd.Series) -> pd.Series:
        def one(s):
            try:
                return json.dumps(yaml.safe_load(s) or {}, default=str, sort_keys=True)
            except yaml.YAMLError:
                return None

        return raw.map(one, na_action="ignore")

    return read(text)
