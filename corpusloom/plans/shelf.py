"""Queries over source texts, indexes, manifests and canons, and their DuckDB SQL. Source texts are made of documents' lines, in
letters and spaces only; small subjects are literal rows."""

from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import canons, markdown, quotes
from corpusloom.plans import made
from corpusloom.plans.literals import frame
from corpusloom.plans.oracles import JUDGED, source_text
from corpusloom.sources import builders


def _plain(line):
    return F.trim(F.regexp_replace(F.regexp_replace(line, "[^A-Za-z ]+", " "), " +", " "))


def _lines(spark, d):
    """(source, i, s): documents' lines in letters and spaces."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", "\n")).alias("i", "line")).select("source", "i", _plain(F.col("line")).alias("s"))


def _texts(spark, d, line, head="", tail=""):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: line(_plain(s), i)), "\n")
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def titled_verses(spark, d):
    """SC9: verses under titles, of texts within an eBook's frame; every seventh line opens the second title again."""
    head = "Preface\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nThe Old Testament of it\nAlpha\nBeta\nAlpha\n1:1 In the beginning, see Page 12 here\n"
    line = lambda s, i: F.concat(F.when(i % 7 == 6, "Beta\n").otherwise(""), (i + 2).cast("string"), F.lit(":"), (i % 3 + 1).cast("string"), F.lit(" "), s)
    out = builders.titled_verses(_texts(spark, d, line, head, "\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicence 9:9 text"), ["Genesis", "Exodus"], frame(spark, ERRATA, ERRATA_ROWS))
    return out.select("source", "section", "chapter", "verse", F.sha2("text", 256).alias("sha"))


ERRATA = {"section": "string", "chapter": "int", "verse": "int", "wrong": "string", "right": "string"}
ERRATA_ROWS = [("Genesis", 1, 1, "beginning", "start"), ("Genesis", 1, 1, "In", "At")]


def numbered_rows(spark, d):
    """SC10: lines `section|verse|text`, remarks and lines of another form among them."""
    line = lambda s, i: F.when(i % 5 == 4, F.concat(F.lit("# "), s)).when(i % 5 == 3, F.concat(F.lit("x|"), s)).otherwise(F.concat((i + 1).cast("string"), F.lit(" | 2|"), s, F.lit(" , a")))
    return builders.numbered_rows(_texts(spark, d, line)).select("source", "n", "section", "verse", F.sha2("text", 256).alias("sha"), "unparsed")


def contiguity(spark, d):
    """XT17: sections and verses that are not contiguous."""
    line = lambda s, i: F.when(i % 11 == 10, "# left out").otherwise(F.concat((F.floor(i / 4) * 2 + 1).cast("string"), F.lit("|"), (i % 4 + 1).cast("string"), F.lit("|x")))
    return builders.contiguity(builders.numbered_rows(_texts(spark, d, line)))


ROMANS = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split()


def _chapters(spark, d):
    names = F.array(*[F.lit(x) for x in ROMANS])
    return _texts(spark, d, lambda s, i: F.concat(F.when(i < 20, F.concat(F.lit("  CHAPTER "), F.get(names, i), F.lit("\n"))).otherwise(""), F.lit("w "), s, F.lit("[FN#6] and, [FN#l6]so")), "no chapter yet\n", "\n[FN#1] a note CHAPTER")


def chapter_rows(spark, d):
    """SC11: chapters with roman numbers, without notes and their marks."""
    return builders.chapters(_chapters(spark, d)).select("source", "ord", "chapter", F.sha2("text", 256).alias("sha"))


def chapter_findings(spark, d):
    """SC11, AG12: chapters that are missing or far longer than the upper median."""
    return builders.chapter_findings(builders.chapters(_chapters(spark, d)), 5, 2)


PAGES = {"source": "string", "page": "long", "text": "string"}
PAGE_ROWS = [("a", 1, "Book Of Things 12 the first words , see www.x.org/y"), ("a", 2, "Book Of Things 13 come be- fore Page 9 the others"), ("a", 3, "Book Of Things 14"), ("a", 4, "other page here 7 | Page of words"), ("b", 1, "Book Of Things 1 few pages"), ("b", 2, None)]


def page_rows(spark, d):
    """SC13: pages without furniture (literal rows)."""
    return builders.pages(frame(spark, PAGES, PAGE_ROWS))


MARKED_ROWS = [("k", 1, "Contents of it {9:9} none"), ("k", 2, "Page 3 Genesis {1:1} In the start { 1 : 2 } And so"), ("k", 3, "1 John {4:19} We love"), ("k", 4, "without marks"), ("k", 5, "John {1:1} The Word {1:1} again"), ("k", 6, "Page 621 {1:2} was with"), ("k", 7, "First John {4:20} If a man")]


def marked_verses(spark, d):
    """SC14: verses between marks, by the section that a page opens (literal rows)."""
    return builders.marked_verses(frame(spark, PAGES, MARKED_ROWS), ["Genesis", "John", "1 John"], {"First John": "1 John"}).select("section", "chapter", "verse", "text")


def index_findings(spark, d):
    """FL17: what is wrong with indexes: order lines as verses, some left out, and documents' lines as blocks and chapters."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <> 2 OR l_orderkey % 4 = 0")
    verses = items.select(F.lit("verses").alias("source"), F.col("l_orderkey").alias("n"), F.lit("s").alias("section"), F.col("l_orderkey").cast("int").alias("chapter"), F.col("l_linenumber").cast("int").alias("verse"), F.when(F.col("l_orderkey") % 50 == 0, "see Page 7").otherwise("x").alias("text"))
    lines = _lines(spark, d)
    blocks = lines.select(F.concat(F.lit("b"), "source").alias("source"), F.col("i").cast("long").alias("n"), F.lit(None).cast("string").alias("section"), F.when(F.col("i") % 6 == 5, 0).otherwise(F.col("i")).alias("chapter"), F.lit(None).cast("int").alias("verse"), F.lit("x").alias("text"))
    chapters = lines.where("i % 4 <> 2").select(F.concat(F.lit("c"), "source").alias("source"), F.col("i").cast("long").alias("n"), F.lit("g").alias("section"), F.when(F.col("i") % 7 == 6, 1).otherwise(F.col("i") + 1).alias("chapter"), F.lit(0).alias("verse"), F.col("s").alias("text"))
    return builders.index_findings(verses.unionByName(blocks).unionByName(chapters))


def embedded_posts(spark, d):
    """SC16: posts that pages carry; some carry none, some another record, some are missing."""
    k = F.col("page_id")
    script = F.concat(F.lit('<script>window._preloads        = JSON.parse("{\\"post\\":{\\"id\\":'), k, F.lit(',\\"body_html\\":\\"<p>x '), k, F.lit('</p>\\"},\\"o\\":1}")</script>'))
    page = F.when(k % 4 == 0, F.concat("html", script)).when(k % 4 == 1, F.col("html")).when(k % 4 == 2, F.concat("html", F.lit('window._preloads = JSON.parse("{\\"pub\\":1}") ; </script>')))
    post = builders.embedded_post(page)
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.get_json_object(post, "$.id").alias("post"), F.get_json_object(post, "$.body_html").alias("body"))


def manifest_lines(spark, d):
    """SC5: fields of manifests, line by line."""
    return builders.manifest_lines(made.rows(spark, d, made.YAML)).select("source", "field", "sub", "value")


def repeated_keys(spark, d):
    """SC6: keys that manifests state more than once."""
    return builders.repeated_keys(made.rows(spark, d, made.YAML))


GENESIS = {"section": "string", "chapter": "int", "verse": "int", "text": "string"}
GENESIS_ROWS = [
    ("Luke", 15, 18, "I will arise and go to my father, and will say unto him, Father, I have sinned against heaven, and before thee,"), ("Luke", 15, 19, "And am no more worthy to be called thy son: make me as one of thy hired servants."),
    ("Luke", 15, 28, "And he was angry, and would not go in: therefore came his father out, and intreated him."), ("John", 10, 30, "I and my Father are one."), ("John", 8, 58, "Jesus said unto them, Verily, verily, I say unto you, Before Abraham was, I am."),
    ("James", 1, 1, "James, a servant of God and of the Lord Jesus Christ, to the twelve tribes which are scattered abroad, greeting."), ("Matthew", 15, 18, "But those things which proceed out of the mouth come forth from the heart; and they defile the man."),
]
NAMED = canons.Canon("bible", sections=["Luke", "John", "James", "Matthew", "1 John"], aliases={"Lk": "Luke"})
NUMBERED = canons.Canon("gita", prefixes=["Gita", "Song"], separator=".", depth=2, section_count=18)

def locus_texts(spark, d):
    """PJ35, JN6: loci of a canon of named sections, book-implied ones among them, and of one of numbered sections."""
    texts, chapters = made.rows(spark, d, made.LOCI), frame(spark, GENESIS, GENESIS_ROWS).select("section", "chapter")
    found = canons.loci(texts, NAMED, "id", chapters).unionByName(canons.loci(texts, NUMBERED, "id"))
    return found.select("id", "section", "chapter", "verse", "hi")


def locus_overlaps(spark, d):
    """FZ8: the longest run of benchmark items' first twelve words that documents of the same number hold."""
    plain = lambda c: norm.source_text(c, ascii_only=True)
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.array_join(F.slice(F.filter(F.split(plain(F.col("text")), " "), lambda w: w != ""), 1, 12), " ").alias("span"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("item_id"), plain(F.col("text")).alias("canon"))
    met = items.join(docs, "item_id").select("item_id", canons.overlap(F.col("span"), F.coalesce("canon", F.lit(""))).alias("x"))
    return met.select("item_id", "x.run", F.round("x.score", 6).alias("score"))


def _quotations(spark, d):
    """(k, a, span): a document's words as they are, with words left out or disclosed in brackets, with another word, or none of them."""
    said = lambda i, n: F.array_join(F.slice("a", i, n), " ")
    k = F.col("k") % 5
    span = F.when(k == 0, said(3, 7)).when(k == 1, F.concat(F.initcap(said(1, 4)), F.lit(" ... "), said(7, 4))).when(k == 2, F.concat(said(3, 3), F.lit(" [Xx] "), said(7, 3))).when(k == 3, F.concat(said(3, 5), F.lit(" zzz "), said(9, 2))).otherwise("zzz yyy, xxx www")
    return made.words(spark, d).withColumn("span", span)


def quotation_matches(spark, d):
    """FZ6: quotations against documents' first words."""
    return _quotations(spark, d).withColumn("m", canons.match(F.col("span"), F.array_join("a", " "))).select("k", "m.ok", "m.detail")


def scripture_spans(spark, d):
    """FZ14: which of the quotations are verses."""
    return _quotations(spark, d).select("k", canons.is_scripture(F.col("span"), F.array_join("a", " ")).alias("scripture"))


def locus_verdicts(spark, d):
    """FZ7: verdicts on quotations beside loci: each document is a section of two verses, the second of every third one missing."""
    docs = made.words(spark, d)
    said = lambda i, n: F.array_join(F.slice("a", i, n), " ")
    section = F.concat(F.lit("b"), "k").alias("section")
    verse = lambda n, text: F.struct(F.lit(n).alias("verse"), text.alias("text"))
    verses = docs.select(section, F.lit(1).alias("chapter"), F.inline(F.array_compact(F.array(verse(1, said(1, 6)), F.when(F.col("k") % 3 != 2, verse(2, said(7, 6)))))))
    k = F.col("k") % 5
    spans = docs.select("k", F.lit(1).alias("no"), F.when(k == 0, said(1, 5)).when(k == 1, said(3, 6)).when(k == 2, F.concat(said(1, 4), F.lit(" zzz"))).when(k == 3, F.concat(said(1, 4), F.lit(" zzz yyy xxx www"))).otherwise("only my own words").alias("span"))
    found = docs.select("k", section, F.lit(1).alias("chapter"), F.when(F.col("k") % 7 == 0, 9).otherwise(1).alias("verse"), F.lit(1).alias("hi"), F.lit(0).alias("at"))
    out = canons.locus_verdicts(spans, found, verses, "k")
    return out.select("k", "no", "status", "section", "chapter", "verse", F.when(F.col("status") == "RANGE", F.col("detail")).otherwise("").alias("range"))


def whole_quotations(spark, d):
    """PJ20, JN5, JN10, FZ2 to FZ5: quotations of drafts go to the notes behind them, notes to the sources that they name, and each
    quotation gets the best verdict of its note's sources; quotations without a held source are told."""
    spans = _cited(spark, d)
    sources = _sources(spark, d)
    best = quotes.best_verdicts(spans, sources, "source", ("name",), blocks=16)
    held = sources.select("name").distinct().withColumn("held", F.lit(True))
    out = spans.join(held, "name", "left").join(best, ["name", "span"], "left")
    return out.select("span_id", "name", "source", F.when(F.col("held").isNull(), "NOT HELD").otherwise(F.coalesce("status", F.lit("NO OVERLAP"))).alias("status"), "run")


def _cited(spark, d):
    """(span_id, span, name): a document's words in italics before a note that names a source."""
    k = F.col("k")
    said = lambda i, n: F.array_join(F.slice("a", i, n), " ")
    body = F.concat(F.lit("x *"), said(2, 8), F.lit("*[^1] y *"), said(1, 5), F.lit(" zzz "), said(7, 4), F.lit("*[^2]\n\n[^1]: in Source "), (k % 4).cast("string"), F.lit("\n\n[^2]: Source "), (k % 7).cast("string"), F.lit(", p. 1"))
    drafts = made.words(spark, d).select("k", body.alias("text"))
    paras = drafts.select("k", F.posexplode(F.split("text", "\n\n")).alias("para", "text"))
    spans = markdown.spans_by_note(paras, "k").select("k", "label", "span")
    notes = markdown.notes(markdown.parsed(drafts, "k"), "k").select("k", "label", F.regexp_extract("text", r"Source \d", 0).alias("name"))
    return spans.join(notes, ["k", "label"]).select(F.concat_ws(":", "k", "label").alias("span_id"), norm.source_text(F.col("span"), ascii_only=True).alias("span"), "name")


def _sources(spark, d):
    """Five named sources, each of a fifth of the documents' first words in order."""
    listed = F.array_sort(F.collect_list(F.struct("k", F.array_join("a", " ").alias("t"))))
    parts = made.words(spark, d).groupBy((F.col("k") % 5).alias("s"), F.floor(F.col("k") / 500).alias("part")).agg(F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("stream"))
    return parts.select(F.concat_ws("/", "s", "part").alias("source"), F.concat(F.lit("Source "), F.col("s").cast("string")).alias("name"), "stream")


QUERIES = {
    f.__name__: f
    for f in (
        titled_verses, numbered_rows, contiguity, chapter_rows, chapter_findings, page_rows, marked_verses, index_findings, embedded_posts, manifest_lines, repeated_keys, locus_texts, locus_overlaps, quotation_matches, locus_verdicts, whole_quotations,
        scripture_spans,
    )
}

_L = r"li AS (SELECT doc_id::VARCHAR AS source, unnest(x) AS raw, unnest(range(len(x)))::INTEGER AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)), ln AS (SELECT source, i, trim(regexp_replace(regexp_replace(raw, '[^A-Za-z ]+', ' ', 'g'), ' +', ' ', 'g')) AS s FROM li)"


def _rows(columns: str, rows: list[tuple], casts: str = "") -> str:
    said = ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in rows)
    return f"SELECT {casts or '*'} FROM (VALUES {said}) AS v({columns})"


ORACLES = {
    "titled_verses": f"""WITH {_L}, h AS (SELECT source, i, s, sum(CASE WHEN i % 7 = 6 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY i) AS b FROM ln),
r AS (SELECT source, CASE b WHEN 0 THEN 'Genesis' WHEN 1 THEN 'Exodus' ELSE 'Beta' END AS section, b, i, i + 2 AS chapter, i % 3 + 1 AS verse, s FROM h WHERE s <> '' UNION ALL SELECT source, 'Genesis', 0, -1, 1, 1, 'At the start, see here' FROM ln GROUP BY source)
SELECT source, section, chapter, verse, sha256(s) AS sha FROM (SELECT *, row_number() OVER (PARTITION BY source, section, chapter, verse ORDER BY i) AS k FROM r) WHERE k = 1""",
    "numbered_rows": f"""WITH {_L} SELECT source, i AS n, CASE WHEN i % 5 < 3 THEN i + 1 END AS section, CASE WHEN i % 5 < 3 THEN 2 END AS verse, CASE WHEN i % 5 < 3 THEN sha256(trim(s || ', a')) END AS sha, CASE WHEN i % 5 = 3 THEN 'x|' || s END AS unparsed FROM ln WHERE i % 5 <> 4""",
    "contiguity": f"""WITH {_L}, r AS (SELECT source, i, i // 4 * 2 + 1 AS section, i % 4 + 1 AS verse FROM ln WHERE i % 11 <> 10), b AS (SELECT DISTINCT source, section FROM (SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY i) AS k FROM r) WHERE verse <> k),
m AS (SELECT source, unnest(range(1, max(section)::BIGINT + 1)) AS section FROM r GROUP BY source)
SELECT source, 'verses not contiguous' AS finding, section::INTEGER AS section FROM b UNION ALL SELECT source, 'section missing', section::INTEGER FROM (SELECT source, section FROM m EXCEPT SELECT source, section FROM r)""",
    "chapter_rows": f"""WITH {_L}, g AS (SELECT source, least(i, 19) AS c, string_agg('w ' || s || ' and, so', ' ' ORDER BY i) AS t FROM ln GROUP BY ALL)
SELECT source, c + 1 AS ord, c + 1 AS chapter, sha256(trim(regexp_replace(regexp_replace(t, ' +', ' ', 'g'), ' ,', ',', 'g'))) AS sha FROM g""",
    "chapter_findings": f"""WITH {_L}, g AS (SELECT source, (least(i, 19) + 1)::INTEGER AS chapter, length(trim(regexp_replace(regexp_replace(string_agg('w ' || s || ' and, so', ' ' ORDER BY i), ' +', ' ', 'g'), ' ,', ',', 'g'))) AS n FROM ln GROUP BY ALL),
m AS (SELECT source, v[len(v) // 2 + 1] AS med FROM (SELECT source, list_sort(list(n)) AS v FROM g GROUP BY source))
SELECT source, 'far longer than the median' AS finding, chapter FROM g JOIN m USING (source) WHERE n > 2 * med UNION ALL SELECT source, 'missing', c::INTEGER FROM (SELECT DISTINCT source, unnest(range(1, 6)) AS c FROM g) ANTI JOIN (SELECT source, chapter AS c FROM g) USING (source, c)""",
    "page_rows": _rows("source, page, text", [("a", 1, "the first words, see"), ("a", 2, "come before the others"), ("a", 4, "other page here of words"), ("b", 1, "Book Of Things 1 few pages")], "source, page::BIGINT AS page, text"),
    "marked_verses": _rows("section, chapter, verse, text", [("Genesis", 1, 1, "In the start"), ("Genesis", 1, 2, "And so"), ("1 John", 4, 19, "We love"), ("John", 1, 1, "The Word"), ("John", 1, 2, "was with"), ("1 John", 4, 20, "If a man")]),
    "index_findings": f"""WITH {_L}, v AS (SELECT l_orderkey AS o, l_linenumber AS k FROM lineitem WHERE l_linenumber <> 2 OR l_orderkey % 4 = 0),
b AS (SELECT 'b' || source AS source, i, CASE WHEN i % 6 = 5 THEN 0 ELSE i END AS c FROM ln), c AS (SELECT 'c' || source AS source, CASE WHEN i % 7 = 6 THEN 1 ELSE i + 1 END AS c, s FROM ln WHERE i % 4 <> 2)
SELECT 'verses' AS source, 'furniture' AS finding, 's' AS section, o::INTEGER AS chapter FROM v WHERE o % 50 = 0 GROUP BY o UNION ALL SELECT 'verses', 'gap', 's', o::INTEGER FROM v GROUP BY o HAVING count(DISTINCT k) < max(k)
UNION ALL SELECT source, 'not ascending', NULL, c FROM (SELECT *, lag(c) OVER (PARTITION BY source ORDER BY i) AS p FROM b) WHERE p > c
UNION ALL SELECT source, 'repeated', 'g', c FROM c GROUP BY source, c HAVING count(*) > 1 UNION ALL SELECT source, 'short', 'g', c FROM c WHERE length(s) < 200
UNION ALL SELECT source, 'missing', 'g', x::INTEGER FROM (SELECT source, unnest(range(1, max(c)::BIGINT + 1)) AS x FROM c GROUP BY source EXCEPT SELECT source, c FROM c)""",
    "embedded_posts": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN page_id::VARCHAR END AS post, CASE WHEN page_id % 4 = 0 THEN '<p>x ' || page_id || '</p>' END AS body FROM pages",
    "repeated_keys": r"SELECT source, field, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '(?m)^([A-Za-z_][\w-]*)\s*:', 1)) AS field FROM y) GROUP BY ALL HAVING count(*) > 1",
    "locus_texts": " UNION ALL ".join(f"SELECT k::VARCHAR AS id, '{x}' AS section, {c} AS chapter, {v} AS verse, {hi} AS hi FROM {made.DOCS} WHERE k % 7 = {n}" for n, rows in made.FOUND_LOCI.items() for x, c, v, hi in rows),
    "quotation_matches": f"SELECT k, k % 5 < 3 AS ok, CASE k % 5 WHEN 0 THEN '1 in order' WHEN 1 THEN '2 in order' WHEN 2 THEN '1 in order' WHEN 3 THEN 'diverges after ' || array_to_string(a[3:7], ' ') ELSE 'not found' END AS detail FROM {made.WORDS}",
    "scripture_spans": f"SELECT k, k % 5 < 2 AS scripture FROM {made.WORDS}",
    "locus_verdicts": f"""SELECT k, CASE WHEN k % 7 > 0 THEN 1 END AS no, CASE WHEN k % 7 = 0 THEN 'NOT IN INDEX' ELSE CASE k % 5 WHEN 0 THEN 'MATCH' WHEN 1 THEN CASE WHEN contains(array_to_string(a[1:6], ' '), array_to_string(a[3:8], ' ')) THEN 'MATCH' WHEN k % 3 = 2 THEN 'DRIFT' ELSE 'RANGE' END WHEN 2 THEN 'DRIFT' WHEN 3 THEN 'SUSPECT' ELSE 'skipped' END END AS status,
 'b' || k AS section, 1 AS chapter, CASE WHEN k % 7 = 0 THEN 9 ELSE 1 END AS verse, CASE WHEN k % 7 > 0 AND k % 5 = 1 AND k % 3 <> 2 AND NOT contains(array_to_string(a[1:6], ' '), array_to_string(a[3:8], ' ')) THEN '1-2' ELSE '' END AS range FROM {made.WORDS}""",
    "manifest_lines": f"""SELECT 'y' || k AS source, unnest(['title', 'images', 'images', 'site', 'title']) AS field, unnest([NULL, 'images/a' || k || '.png', 'b', NULL, NULL]) AS sub, unnest([trim('T ' || w), 'https://x.org/' || k, 'c', 'true', 'again']) AS value FROM {made.DOCS} WHERE k % 4 = 0
UNION ALL SELECT 'y' || k, unnest(['tags', 'url', 'url', 'url']), NULL, unnest(['[a, b]', 'https://x.org/' || k, 'twice', 'thrice']) FROM {made.DOCS} WHERE k % 4 = 3""",
    "whole_quotations": f"""WITH RECURSIVE wd AS (SELECT k, a FROM {made.WORDS}), st AS (SELECT k % 5 AS s, k // 500 AS part, string_agg(array_to_string(a, ' '), ' ' ORDER BY k) AS stream FROM wd GROUP BY ALL),
d AS (SELECT s || '/' || part AS doc_id, s, stream FROM st), sq AS (SELECT k || ':1' AS span_id, k % 4 AS n, array_to_string(a[2:9], ' ') AS span FROM wd UNION ALL SELECT k || ':2', k % 7, array_to_string(a[1:5], ' ') || ' zzz ' || array_to_string(a[7:10], ' ') FROM wd),
sp AS (SELECT span_id, span FROM sq), """
    + JUDGED.replace("{pairs}", "pr AS (SELECT span_id, doc_id FROM sq JOIN d ON s = n),\n")
    + """ SELECT sq.span_id, 'Source ' || n AS name, doc_id AS source, CASE WHEN n > 4 THEN 'NOT HELD' ELSE coalesce(status, 'NO OVERLAP') END AS status, run FROM sq LEFT JOIN v8 ON v8.span_id = sq.span_id AND rk = 1""",
    "repeated_keys": r"SELECT source, field, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '(?m)^([A-Za-z_][\w-]*)\s*:', 1)) AS field FROM y) GROUP BY ALL HAVING count(*) > 1",
    "locus_texts": " UNION ALL ".join(f"SELECT k::VARCHAR AS id, '{x}' AS section, {c} AS chapter, {v} AS verse, {hi} AS hi FROM {made.DOCS} WHERE k % 7 = {n}" for n, rows in made.FOUND_LOCI.items() for x, c, v, hi in rows),
    "quotation_matches": f"SELECT k, k % 5 < 3 AS ok, CASE k % 5 WHEN 0 THEN '1 in order' WHEN 1 THEN '2 in order' WHEN 2 THEN '1 in order' WHEN 3 THEN 'diverges after ' || array_to_string(a[3:7], ' ') ELSE 'not found' END AS detail FROM {made.WORDS}",
    "scripture_spans": f"SELECT k, k % 5 < 2 AS scripture FROM {made.WORDS}",
    "locus_verdicts": f"""SELECT k, CASE WHEN k % 7 > 0 THEN 1 END AS no, CASE WHEN k % 7 = 0 THEN 'NOT IN INDEX' ELSE CASE k % 5 WHEN 0 THEN 'MATCH' WHEN 1 THEN CASE WHEN contains(array_to_string(a[1:6], ' '), array_to_string(a[3:8], ' ')) THEN 'MATCH' WHEN k % 3 = 2 THEN 'DRIFT' ELSE 'RANGE' END WHEN 2 THEN 'DRIFT' WHEN 3 THEN 'SUSPECT' ELSE 'skipped' END END AS status,
 'b' || k AS section, 1 AS chapter, CASE WHEN k % 7 = 0 THEN 9 ELSE 1 END AS verse, CASE WHEN k % 7 > 0 AND k % 5 = 1 AND k % 3 <> 2 AND NOT contains(array_to_string(a[1:6], ' '), array_to_string(a[3:8], ' ')) THEN '1-2' ELSE '' END AS range FROM {made.WORDS}""",
    "manifest_lines": f"""SELECT 'y' || k AS source, unnest(['title', 'images', 'images', 'site', 'title']) AS field, unnest([NULL, 'images/a' || k || '.png', 'b', NULL, NULL]) AS sub, unnest([trim('T ' || w), 'https://x.org/' || k, 'c', 'true', 'again']) AS value FROM {made.DOCS} WHERE k % 4 = 0
UNION ALL SELECT 'y' || k, unnest(['tags', 'url', 'url', 'url']), NULL, unnest(['[a, b]', 'https://x.org/' || k, 'twice', 'thrice']) FROM {made.DOCS} WHERE k % 4 = 3""",
}
_W = "list_filter(string_split(" + source_text() + ", ' '), lambda w: w <> '')"
ORACLES["locus_overlaps"] = f"""WITH i AS (SELECT item_id, ({_W})[1:12] AS w FROM benchmark), d AS (SELECT doc_id AS item_id, coalesce({source_text()}, '') AS c FROM documents),
p AS (SELECT item_id, w, c, unnest(range(1, len(w) + 1)) AS a FROM i JOIN d USING (item_id)), q AS (SELECT *, unnest(range(a, len(w) + 1)) AS b FROM p)
SELECT item_id, coalesce(max(b - a + 1) FILTER (contains(c, array_to_string(w[a:b], ' '))), 0)::INTEGER AS run, round(coalesce(max(b - a + 1) FILTER (contains(c, array_to_string(w[a:b], ' '))), 0) / max(len(w)), 6) AS score FROM q GROUP BY item_id"""
ORACLES["repeated_keys"] = f"WITH {made.SQL['yaml']} " + ORACLES["repeated_keys"]
