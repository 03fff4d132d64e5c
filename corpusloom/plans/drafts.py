"""Queries over Markdown drafts, and their DuckDB SQL. Drafts are made of documents: each line becomes a block of one of eight
kinds (headings, quotations, lists, notes and references, figures, quoted prose), by the document's and the line's number."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import markdown as md
from corpusloom.plans import made
from corpusloom.plans.oracles import page_text, short, source_text

HEAD = "title: a title\n---\n<!-- hidden\nremark -->\n"


def drafts(spark, d) -> DataFrame:
    """(doc_id, text): a draft for each document that has a text."""
    doc, n = F.col("doc_id"), lambda i, k: (i + k).cast("string")

    def block(line, i):
        s, t = F.translate(line, '*"[]`<>_†‡“”()', ""), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        kinds = (
            t("## ", s),
            t("> ", s, "\n> next line\n\n> again"),
            t("---\n\n- ", s, "\n  more *words* here\n- second **item**"),
            t(s, "[^n", n(i, 100), "] and [a link](https://example.org/p/", n(i, 0), "/)"),
            t("[^n", n(i, 99), "]: ", s, " see [^q] † Verify later"),
            t("    ", s),
            t("![alt ", n(i, 0), "](images/", doc.cast("string"), "-", n(i, 0), ".png)"),
            t('**Bold** "', s, '" *quoted italics here* [^n', n(i, 100), "] [^n", n(i, 96), "] <https://auto.example.org/", n(i, 0), "> and https://bare.example.org/", n(i, 0), "."),
        )
        which = F.pmod(doc + i, F.lit(8))
        out = F.lit(None).cast("string")
        for k, text in enumerate(kinds):
            out = F.when(which == k, text).otherwise(out)
        return out

    body = F.array_join(F.transform(F.split("text", "\n"), block), "\n\n")
    return spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.concat(F.lit(HEAD), body).alias("text"))


DRAFTS = r"""
dr AS (SELECT doc_id, 'title: a title' || chr(10) || '---' || chr(10) || '<!-- hidden' || chr(10) || 'remark -->' || chr(10) || array_to_string(list_transform(
 list_transform(string_split(text, chr(10)), lambda x: translate(x, '*"[]`<>_†‡“”()', '')), lambda s, j: CASE (doc_id + j - 1) % 8
 WHEN 0 THEN '## ' || s WHEN 1 THEN '> ' || s || chr(10) || '> next line' || chr(10) || chr(10) || '> again'
 WHEN 2 THEN '---' || chr(10) || chr(10) || '- ' || s || chr(10) || '  more *words* here' || chr(10) || '- second **item**'
 WHEN 3 THEN s || '[^n' || (j + 99) || '] and [a link](https://example.org/p/' || (j - 1) || '/)'
 WHEN 4 THEN '[^n' || (j + 98) || ']: ' || s || ' see [^q] † Verify later' WHEN 5 THEN '    ' || s
 WHEN 6 THEN '![alt ' || (j - 1) || '](images/' || doc_id || '-' || (j - 1) || '.png)'
 ELSE '**Bold** "' || s || '" *quoted italics here* [^n' || (j + 99) || '] [^n' || (j + 95) || '] <https://auto.example.org/' || (j - 1) || '> and https://bare.example.org/' || (j - 1) || '.' END),
 chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL),
bo AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?s)\A(?:.*?\n)??[ \t\r]*---[ \t\r]*(?:\n|\z)', ''), '\A[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+\z', '', 'g') AS body FROM dr),
ra AS (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS idx FROM (SELECT doc_id, list_filter(string_split_regex(body, '\n[ \t]*\n'), lambda b: regexp_matches(b, '[^\s\x0B\x{85}\p{Z}]')) AS l FROM bo)),
sr AS (SELECT doc_id, idx, raw, regexp_replace(raw, '\A[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+\z', '', 'g') AS src, regexp_matches(raw, '\A(?: {4,}|\t)\S') AS ind FROM ra),
la AS (SELECT *, CASE WHEN NOT ind THEN regexp_extract(src, '(?s)\A\[\^(\w+)\]:\s?(.*)\z', 1) END AS lab FROM sr),
op AS (SELECT *, last_value(lab IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS opened FROM la),
pa AS (SELECT doc_id, idx, raw, src, coalesce(CASE WHEN ind THEN opened ELSE lab END, '') AS label, CASE WHEN NOT ind AND lab <> '' THEN 'note' WHEN ind AND coalesce(opened, '') <> '' THEN 'more' ELSE 'body' END AS p0 FROM op),
bl AS (SELECT doc_id, idx, src, label, CASE WHEN p0 = 'body' AND lag(p0) OVER (PARTITION BY doc_id ORDER BY idx) IN ('note', 'more') AND NOT regexp_matches(src, '\A(---|#|>|[-*+]\s|!\[|\|)') THEN 'orphan' ELSE p0 END AS part FROM pa),
bk AS (SELECT *, CASE WHEN part IN ('note', 'more') THEN NULL WHEN src = '---' THEN 'hr' WHEN starts_with(src, '### ') THEN 'h3' WHEN starts_with(src, '## ') THEN 'h2' WHEN starts_with(src, '![') THEN 'figure' WHEN regexp_matches(src, '\A[-*]\s') THEN 'ul' WHEN starts_with(src, '> ') THEN 'blockquote' ELSE 'p' END AS kind FROM bl),
bj AS (SELECT *, sum(CASE WHEN kind = 'blockquote' AND pk = 'blockquote' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS g FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY idx) AS pk FROM bk WHERE part IN ('body', 'orphan'))),
bb AS (SELECT doc_id, min(idx) AS idx, any_value(kind) AS kind, string_agg(src, chr(10) || chr(10) ORDER BY idx) AS src FROM bj GROUP BY doc_id, g)"""


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g'))"


CLEAN = r"trim(regexp_replace(regexp_replace({0}, '(?s)\s*[†‡].*\z', ''), '(?s)\s*\bVerify\b[^.]*\.\s*\z', ''))"

NOTES = (
    DRAFTS
    + r""",
n0 AS (SELECT doc_id, idx, part, label, sum(CASE WHEN part = 'note' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS no, """
    + collapse(r"CASE WHEN part = 'note' THEN regexp_extract(src, '(?s)\A\[\^(\w+)\]:\s?(.*)\z', 2) ELSE src END")
    + r""" AS raw FROM bl WHERE part IN ('note', 'more')),
n1 AS (SELECT *, """
    + CLEAN.format("raw")
    + r""" AS t, CASE WHEN regexp_matches(raw, '[†‡]') THEN trim(regexp_extract(raw, '(?s)[†‡](.*)\z', 1)) ELSE '' END AS r FROM n0),
n2 AS (SELECT doc_id, label, no, coalesce(string_agg(t, ' ' ORDER BY idx) FILTER (t <> ''), '') AS text, coalesce(string_agg(r, ' ' ORDER BY idx) FILTER (r <> ''), '') AS removed FROM n1 GROUP BY doc_id, label, no),
nn AS (SELECT doc_id, label, max_by(text, no) AS text, max_by(removed, no) AS removed FROM n2 GROUP BY doc_id, label),
rf AS (SELECT doc_id, label, min(idx * 1000000 + pos) AS seen_at, count(*) AS refs FROM (SELECT doc_id, idx, unnest(m) AS label, unnest(range(len(m))) AS pos FROM (SELECT doc_id, idx, regexp_extract_all(src, '\[\^(\w+)\]', 1) AS m FROM bb)) GROUP BY doc_id, label),
od AS (SELECT doc_id, label, text, removed, row_number() OVER (PARTITION BY doc_id ORDER BY seen_at)::INTEGER AS number FROM nn JOIN rf USING (doc_id, label))"""
)


def inline_sql(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = f"replace({x}, '{a}', '{b}')"
    for pattern, to in ((r"\[\^(\w+)\]", r"[[FN\1]]"), (r"!\[(.*?)\]\((.*?)\)", r'<figure><img src="\2" alt="\1"></figure>'), (r"\[([^\[\]]+?)\]\(([^)]+?)\)", r'<a href="\2">\1</a>'), (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"\*(.+?)\*", r"<em>\1</em>")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def reader_sql(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(regexp_replace({x}, '\[\[FN[^\]]*\]\]', '', 'g'), '(?s)<figcaption>.*?</figcaption>', '', 'g'), '<[^>]+>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return collapse(x)


RENDERED = (
    NOTES
    + r""",
hb AS (SELECT doc_id, idx, kind, lag(kind) OVER (PARTITION BY doc_id ORDER BY idx) = 'hr' AS divided, CASE kind WHEN 'hr' THEN '<hr>' WHEN 'h3' THEN '<h3>' || """
    + inline_sql("substr(src, 5)")
    + " || '</h3>' WHEN 'h2' THEN '<h2>' || "
    + inline_sql("substr(src, 4)")
    + " || '</h2>' WHEN 'figure' THEN "
    + inline_sql("src")
    + r""" WHEN 'ul' THEN '<ul>' || array_to_string(list_transform(string_split(replace(regexp_replace(src, '[ \t]*\n[ \t]*', chr(10), 'g'), chr(10) || 'more', ' more'), chr(10)), lambda i: '<li>' || """
    + inline_sql(r"regexp_replace(i, '\A[-*]\s+', '')")
    + r""" || '</li>'), '') || '</ul>' WHEN 'blockquote' THEN '<blockquote>' || array_to_string(list_transform(string_split(src, chr(10) || chr(10)), lambda q: '<p>' || """
    + inline_sql(r"replace(regexp_replace(q, '(?m)^>[ \t]?', '', 'g'), chr(10), ' ')")
    + " || '</p>'), '') || '</blockquote>' ELSE '<p>' || "
    + inline_sql("replace(src, chr(10), ' ')")
    + " || '</p>' END AS html FROM bb),\nrr AS (SELECT doc_id, 'body' AS part, idx AS seen_at, html, coalesce(divided, false) AS divided, kind FROM hb UNION ALL SELECT doc_id, 'fns', number, "
    + inline_sql("text")
    + ", false, 'p' FROM od),\nrt AS (SELECT *, "
    + reader_sql("html")
    + " AS text FROM rr WHERE kind <> 'hr'),\nrd AS (SELECT doc_id, part, html, text, divided, (row_number() OVER (PARTITION BY doc_id, part ORDER BY seen_at) - 1)::INTEGER AS idx FROM rt WHERE text <> '' OR part = 'fns')"
)


def draft_blocks(spark, d):
    """PJ1, PJ2, PJ4: parts and kinds of drafts' blocks."""
    return md.parsed(drafts(spark, d), "doc_id").select("doc_id", "idx", "part", "label", "kind")


def draft_body_blocks(spark, d):
    """PJ7: blocks of the body, neighbouring quotations as one."""
    return md.body_blocks(md.parsed(drafts(spark, d), "doc_id"), "doc_id").select("doc_id", "idx", "kind", F.sha2("src", 256).alias("sha"))


def draft_notes(spark, d):
    """PJ4, PJ5, PJ6, PJ19, WN1: notes in the order of their first references, cleaned."""
    return md.ordered_notes(md.parsed(drafts(spark, d), "doc_id"), "doc_id").select("doc_id", "label", "number", "text", "removed")


def draft_note_issues(spark, d):
    """PJ5: what is wrong with drafts' notes."""
    return md.note_issues(md.parsed(drafts(spark, d), "doc_id"), "doc_id")


def draft_reader(spark, d):
    """PJ3, PJ8, XT6: drafts as readers see them."""
    return md.rendered(drafts(spark, d), "doc_id").select("doc_id", "part", "idx", F.sha2("html", 256).alias("html_sha"), "h", "divided")


def draft_reader_digest(spark, d):
    """AG10: one digest of a draft's blocks and notes, each followed by a record separator."""
    rows = md.rendered(drafts(spark, d), "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "idx", "text"))).alias("all"))
    return rows.select("doc_id", F.sha2(F.concat(F.array_join(F.transform("all", lambda x: x["text"]), "\x1e"), F.lit("\x1e")), 256).alias("digest"))


def draft_residual(spark, d):
    """FL7: rendered rows with desk dates or requests; lines of odd documents get one."""
    docs = drafts(spark, d).withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat("text", F.lit("\n\nconsulted 2026-09-07 by us"))).otherwise(F.concat("text", F.lit("\n\n![on 2026-09-07](images/x.png)"))))
    return md.residual(md.rendered(docs, "doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def draft_internal_stripped(spark, d):
    """PJ18: drafts' bodies without internal remarks."""
    return md.internal_stripped(md.parsed(drafts(spark, d), "doc_id"), "doc_id").select("doc_id", F.sha2("text", 256).alias("sha"))


def draft_paragraphs(spark, d):
    """PJ17: paragraphs that a page should show."""
    return drafts(spark, d).select("doc_id", md.publishable_paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.sha2(F.array_join("p", "\n"), 256).alias("sha"))


def draft_spans(spark, d):
    """PJ20, JN5: quoted spans with the note that follows them."""
    body = md.body_blocks(md.parsed(drafts(spark, d), "doc_id"), "doc_id").where("kind = 'p'")
    return md.spans_by_note(body.select("doc_id", F.col("idx").alias("para"), F.col("src").alias("text")), "doc_id")


def draft_locus_spans(spark, d):
    """PJ21: spans of the kind that is compared with verses."""
    return drafts(spark, d).select("doc_id", F.posexplode(md.locus_spans(md.published(F.col("text")))).alias("pos", "span")).select("doc_id", "span")


def draft_urls(spark, d):
    """PJ24, SO1: addresses of drafts in three forms, and whether readers would see them as text."""
    rows = drafts(spark, d).select("doc_id", md.urls(F.col("text")).alias("urls"), md.unrenderable(F.col("text")).alias("naked"))
    return rows.select("doc_id", F.explode("urls").alias("url"), "naked").select("doc_id", "url", F.array_contains("naked", F.col("url")).alias("naked"))


def draft_images(spark, d):
    """PJ26: image files of drafts, the hero first."""
    hero = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("../images/hero"), "doc_id", F.lit(".png")))
    return drafts(spark, d).select("doc_id", F.posexplode(md.image_files(F.col("text"), hero, F.array(F.lit("./images/listed.png"), F.lit("elsewhere/x.png")))).alias("pos", "file"))


def draft_article(spark, d):
    """XT7: drafts for a place without notes."""
    return md.article(drafts(spark, d), "doc_id").select("doc_id", "part", "idx", F.sha2("html", 256).alias("sha"), "figure")


def titles(spark, d):
    """PJ31, PJ32, PJ33, PJ25: headings, names without emphasis, stanzas by form, broken addresses."""
    t = made.rows(spark, d, made.TITLES)
    return t.select("id", md.h1_title(F.col("text")).alias("title"), md.unemphasized(F.col("name")).alias("name"), F.array_join(md.stanzas(F.col("body"), F.col("form")), "|").alias("parts"), md.has_wrapped_url(F.col("body")).alias("wrapped"))


def title_claims(spark, d):
    """PJ33, JN19, AG16: titles that texts claim for slugs."""
    t = made.rows(spark, d, made.TITLES)
    both = t.select("id", F.explode(md.title_claims(F.concat_ws("\n", "text", "body"))).alias("c"))
    return both.select("id", "c.slug", "c.title")


def normal_forms(spark, d):
    """N1, N2, N6, N8, N9, N11, N13, N14, N16, N17, N18 and N4 over benchmark items with marks added."""
    text = F.concat(F.lit('“A” [1] *b* '), F.col("text"), F.lit(" – it's 12 \"q\" [x](https://x.org/a/b/) Page 7"))
    r = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", text.alias("t"))
    marks = F.array(F.struct(F.lit("em").alias("kind"), F.substring("t", 1, 9).alias("text"), F.lit(None).cast("string").alias("href")), F.struct(F.lit("link").alias("kind"), F.lit("“x  y”").alias("text"), F.lit("https://x.org").alias("href")))
    link = F.concat(F.lit("https://x.org/p/"), "item_id", F.when(F.col("item_id") % 2 == 0, "/").otherwise(""))
    image = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("https://cdn.org/fetch/w_1/https%3A%2F%2Fs3.org%2Fi%2F"), "item_id", F.lit(".png"))).otherwise(F.concat(F.lit("https://s3.org/"), "item_id"))
    t = F.col("t")
    return r.select(
        "item_id", norm.flat_quotes(t).alias("n1"), norm.smart_quotes(F.lit('say "it\'s" (\'so\')')).alias("n2"), norm.marks_digest(marks).alias("n4"), F.when(~F.col("t").rlike(r"[^\x00-\x7F“”–]"), norm.verse_text(t)).alias("n6"), norm.header_text(t).alias("n8"), norm.title_text(t).alias("n9"),
        norm.plain_markdown(t).alias("n11"), norm.ingested(F.concat(F.lit("be-\nlieve , so "), t)).alias("n12"), norm.scrubbed(t, r"\bPage\s+\d+\b").alias("n13"), norm.without_numbers(t).alias("n14"), norm.slug(t).alias("n16"), norm.canonical_href(link).alias("n17"), norm.canonical_image(image).alias("n18"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        draft_blocks, draft_body_blocks, draft_notes, draft_note_issues, draft_reader, draft_reader_digest, draft_residual, draft_internal_stripped, draft_paragraphs, draft_spans, draft_locus_spans, draft_urls, draft_images, draft_article,
        titles, title_claims, normal_forms,
    )
}

_T = "t AS (SELECT '“A” [1] *b* ' || text || ' – it''s 12 \"q\" [x](https://x.org/a/b/) Page 7' AS t, item_id FROM benchmark)"
_FLAT = "translate(t, '‘’“”', '''''\"\"')"
_PLAIN = "t"
for _p, _to in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^\[\^[^\]]+\]:.*$", ""), (r"\[\^[^\]]+\]", ""), (r"(?m)^#+\s*", ""), (r"(?m)^[-*]\s+", ""), (r"[*_`>]", "")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_p}', '{_to}', 'g')"

#: Marks of emphasis as patterns, the longest first.
MARKS = (r"\*\*\*", r"\*\*", r"\*", "__", "_")

ORACLES = {
    "page_reader_text": f"SELECT page_id, sha256({reader_sql('html')}) AS sha256 FROM pages",
    "source_text_digests": f"SELECT item_id, {source_text('strip_accents(text)')} AS normal FROM benchmark",
    "aligned_lines": """WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, len(list_distinct(string_split(text, chr(10)))) AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'changed' AS op, 1::BIGINT AS n FROM l WHERE k = 1 UNION ALL SELECT doc_id, 'equal', n - 1 FROM l WHERE n > 1 UNION ALL SELECT doc_id, 'removed', 1 FROM l WHERE k > 1 UNION ALL SELECT doc_id, 'added', 1 FROM l WHERE k > 1""",
    "draft_blocks": f"WITH {DRAFTS} SELECT doc_id, idx::INTEGER AS idx, part, label, kind FROM bk",
    "draft_body_blocks": f"WITH {DRAFTS} SELECT doc_id, idx::INTEGER AS idx, kind, sha256(src) AS sha FROM bb",
    "draft_notes": f"WITH {NOTES} SELECT doc_id, label, number, text, removed FROM od",
    "draft_note_issues": f"WITH {NOTES} "
    r"""SELECT doc_id, label, 'undefined' AS issue FROM rf ANTI JOIN nn USING (doc_id, label) UNION ALL SELECT doc_id, label, 'unreferenced' FROM nn ANTI JOIN rf USING (doc_id, label)
UNION ALL SELECT doc_id, label, 'duplicated' FROM rf WHERE refs > 1 UNION ALL (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\[\^(\w+)\]', 1)), 'nested' FROM nn)
UNION ALL SELECT doc_id, label, 'orphaned' FROM (SELECT doc_id, part, last_value(CASE WHEN part IN ('note', 'more') THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS label FROM bl) WHERE part = 'orphan'""",
    "draft_reader": f"WITH {RENDERED} SELECT doc_id, part, idx, sha256(html) AS html_sha, {short('text')} AS h, divided FROM rd",
    "draft_reader_digest": f"WITH {RENDERED} SELECT doc_id, sha256(string_agg(text, chr(30) ORDER BY part, idx) || chr(30)) AS digest FROM rd GROUP BY doc_id",
    "draft_residual": "WITH " + RENDERED.replace("chr(10) || chr(10)) AS text FROM documents", "chr(10) || chr(10)) || CASE WHEN doc_id % 2 = 1 THEN chr(10) || chr(10) || 'consulted 2026-09-07 by us' ELSE chr(10) || chr(10) || '![on 2026-09-07](images/x.png)' END AS text FROM documents")
    + r""" SELECT doc_id, count(*) AS n FROM rd WHERE part = 'fns' AND regexp_matches(html, '(?i)verify') OR regexp_matches(regexp_replace(html, '\salt="[^"]*"', ' alt=""', 'g'), '(?i)\b20\d\d-\d\d-\d\d\b|\b(?:consulted|accessed|retrieved)\s+(?:on\s+)?(?:\d|20\d\d|[A-Z][a-z]+ \d)') GROUP BY doc_id""",
    "draft_internal_stripped": f"WITH {DRAFTS}, c AS (SELECT doc_id, idx, part, label, src, {CLEAN.format(collapse(r'''CASE WHEN part = 'note' THEN regexp_extract(src, '(?s)\A\[\^(\w+)\]:\s?(.*)\z', 2) ELSE src END'''))} AS t FROM bl), "
    "l AS (SELECT doc_id, idx, CASE part WHEN 'note' THEN CASE WHEN t <> '' THEN '[^' || label || ']: ' || t END WHEN 'more' THEN CASE WHEN t <> '' THEN '    ' || t END ELSE src END AS line FROM c) "
    "SELECT doc_id, sha256(string_agg(line, chr(10) || chr(10) ORDER BY idx)) AS sha FROM l WHERE line IS NOT NULL GROUP BY doc_id",
    "draft_spans": f"WITH {DRAFTS}, "
    r"""k AS (SELECT doc_id, idx, replace(src, '**Bold**', '        ') AS src, regexp_extract_all(src, '\[\^([\w-]+)\]', 1) AS labels FROM bb WHERE kind = 'p')
SELECT doc_id, idx::INTEGER AS para, labels[1] AS label, span FROM (SELECT doc_id, idx, labels, unnest(list_concat(list_filter(regexp_extract_all(src, '\*([^*]+)\*', 1), lambda x: length(x) >= 12), list_filter(regexp_extract_all(src, '["“]([^"”]+)["”]', 1), lambda x: length(x) >= 12))) AS span FROM k WHERE len(labels) > 0)""",
    "draft_urls": f"WITH {DRAFTS}, "
    r"""u AS (SELECT doc_id, body, unnest(list_concat(regexp_extract_all(text, '\]\((https?://[^)\s]+)\)', 1), regexp_extract_all(text, '<(https?://[^>\s]+)>', 1), regexp_extract_all(text, '(?:\A|[^(<\[])(https?://[^\s<>()\[\]]+)', 1))) AS url FROM bo)
SELECT DISTINCT doc_id, url, NOT contains(body, '](' || url || ')') AS naked FROM (SELECT doc_id, body, regexp_replace(url, '[.,;:!?''"*_`]+\z', '') AS url FROM u)""",
    "draft_images": f"WITH {DRAFTS}, "
    r"""i AS (SELECT doc_id, list_concat(CASE WHEN doc_id % 3 = 0 THEN ['images/hero' || doc_id || '.png'] ELSE [] END, ['images/listed.png'], regexp_extract_all(text, '!\[[^\]]*\]\(([^)\s]+)', 1)) AS l FROM dr)
SELECT doc_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS file FROM i""",
    "draft_article": f"WITH {RENDERED}, "
    r"""a AS (SELECT doc_id, part, idx, html FROM rd WHERE NOT (part = 'body' AND idx = 0 AND starts_with(html, '<figure>'))),
x AS (SELECT doc_id, part, idx, unnest(s) AS s, unnest(list_concat(m, [NULL])) AS label, unnest(range(len(s))) AS k FROM (SELECT doc_id, part, idx, string_split_regex(html, '\[\[FN\w+\]\]') AS s, regexp_extract_all(html, '\[\[FN(\w+)\]\]', 1) AS m FROM a)),
y AS (SELECT x.doc_id, x.part, x.idx, string_agg(s || CASE WHEN x.label IS NULL THEN '' ELSE '[' || coalesce(number, 0) || ']' END, '' ORDER BY k) AS html FROM x LEFT JOIN od ON od.doc_id = x.doc_id AND od.label = x.label GROUP BY ALL)
SELECT doc_id, part, idx, sha256(html) AS sha, (CASE WHEN starts_with(html, '<figure>') THEN sum(CASE WHEN starts_with(html, '<figure>') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, part ORDER BY idx) END)::INTEGER AS figure FROM y""",
    "draft_paragraphs": f"WITH {DRAFTS}, "
    r"""g AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '†[^\n]*', '', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '(?m)^\[\^[\w-]+\]:[^\n]*', '', 'g'), '\[\^[\w-]+\]', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '[*_`>#]+', '', 'g') AS t FROM bo),
l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda p: """
    + page_text("p")
    + """), lambda p: length(p) >= 40) AS l FROM g) SELECT doc_id, len(l)::BIGINT AS n, sha256(array_to_string(l, chr(10))) AS sha FROM l""",
    "draft_locus_spans": f"WITH {DRAFTS}, "
    r"""c AS (SELECT doc_id, regexp_replace(body, '\[\*[^*]+\*\]\([^)]*\)', ' ', 'g') AS t FROM bo),
r AS (SELECT doc_id, list_concat(regexp_extract_all(t, '\*([^*]{12,})\*', 1), regexp_extract_all(regexp_replace(t, '[*_]+', '', 'g'), '[“"]([^”"]{12,})[”"]', 1)) AS l FROM c),
u AS (SELECT doc_id, unnest(l) AS span, unnest(range(len(l))) AS pos FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(span, '[^A-Za-z0-9]+', ' ', 'g')) ORDER BY pos) AS nth FROM u WHERE regexp_matches(span, '[A-Za-z0-9]'))
SELECT doc_id, span FROM k WHERE nth = 1""",
    "titles": f"WITH {made.SQL['titles']}, "
    + ", ".join(f"u{i} AS (SELECT * REPLACE (trim(CASE {' '.join(f"WHEN regexp_matches(name, '(?s)\\A{m}(.+?){m}\\z') THEN regexp_extract(name, '(?s)\\A{m}(.+?){m}\\z', 1)" for m in MARKS)} ELSE name END) AS name) FROM {source})" for i, source in enumerate(("(SELECT * REPLACE (trim(name) AS name) FROM t)", "u0", "u1")))
    + r""" SELECT id, nullif(trim(regexp_replace(trim(regexp_extract(text, '(?m)^# (.*)$', 1)), '\s*\*\(.*\z', '')), '') AS title,
name,
array_to_string(list_filter(list_transform(string_split_regex(body, '\n[ \t]*\n'), lambda p: CASE WHEN form = 'poem' THEN regexp_replace(p, '\A\s+|\s+\z', '', 'g') ELSE trim(regexp_replace(p, '\s+', ' ', 'g')) END), lambda p: p <> ''), '|') AS parts,
regexp_matches(body, '\]\(\s*https?://[^)]*?\n[^)]*?\)') AS wrapped FROM u2""",
    "title_claims": f"""WITH d AS (SELECT k::VARCHAR AS id, w FROM {made.DOCS} WHERE k % 6 = 5)
SELECT id, 'long-walk' AS slug, w AS title FROM d WHERE w <> '' UNION ALL SELECT id, 'the-gate', trim('A ' || w) FROM d UNION ALL SELECT id, 'hill-two', trim('Hill ' || w) FROM d UNION ALL SELECT id, 'long-walk', trim('The ' || w) FROM d UNION ALL SELECT id, 'x', 'two lines' FROM d""",
    "normal_forms": f"WITH {_T} SELECT item_id, {_FLAT} AS n1, 'say “it’s” (‘so’)' AS n2, {short('m')} AS n4, "
    rf"CASE WHEN NOT regexp_matches(t, '[^\x00-\x7F“”–]') THEN trim(regexp_replace(regexp_replace(lower(translate({_FLAT}, '[]', '')), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')) END AS n6, "
    rf"trim(regexp_replace(replace({_FLAT}, '–', '-'), '\s+', ' ', 'g')) AS n8, trim(regexp_replace({_FLAT}, '\s+', ' ', 'g')) AS n9, trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g')) AS n11, "
    rf"'believe, so ' || regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ([,.;:!?])', '\1', 'g') AS n12, regexp_replace(regexp_replace(t, '(?i)\bPage\s+\d+\b', ' ', 'g'), '\s{{2,}}', ' ', 'g') AS n13, "
    rf"trim(regexp_replace(regexp_replace(t, '\b\d{{1,4}}\b', ' ', 'g'), '\s+', ' ', 'g')) AS n14, regexp_replace(regexp_replace(regexp_replace(lower(t), '[’'']', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS n16, "
    "'https://x.org/p/' || item_id AS n17, CASE WHEN item_id % 2 = 0 THEN 'https://s3.org/i/' || item_id || '.png' ELSE 'https://s3.org/' || item_id END AS n18 FROM (SELECT *, 'em|' || trim(substr(translate(t, '‘’“”', '''''\"\"'), 1, 9)) || '|' || chr(1) || 'link|\"x y\"|https://x.org' AS m FROM t)",
}
