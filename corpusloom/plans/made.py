"""Scaffolds, manifests, claims and drafts made of documents, as frames and as common table expressions of the same rows.

A field is one of several templates, by the document's number; {k} is the number, {s} the document's first 80 characters in ASCII, {w}
their words in letters. None is a null field."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCS = r"(SELECT doc_id AS k, regexp_replace(substr(text, 1, 80), '[^\x00-\x7F]', '', 'g') AS s, trim(regexp_replace(regexp_replace(substr(text, 1, 80), '[^A-Za-z ]+', ' ', 'g'), ' +', ' ', 'g')) AS w FROM documents WHERE text IS NOT NULL)"


def docs(spark, d) -> DataFrame:
    """(k, s, w)."""
    head = F.substring("text", 1, 80)
    words = F.trim(F.regexp_replace(F.regexp_replace(head, "[^A-Za-z ]+", " "), " +", " "))
    return spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").alias("k"), F.regexp_replace(head, r"[^\x00-\x7F]", "").alias("s"), words.alias("w"))


Field = list[str | None]


def _column(template: str | None) -> Column:
    if template is None:
        return F.lit(None).cast("string")
    parts = [p for p in re.split(r"(\{[ksw]\})", template) if p]
    return F.concat(F.lit(""), *(F.col(p[1]).cast("string") if re.fullmatch(r"\{[ksw]\}", p) else F.lit(p) for p in parts))


def _sql(template: str | None) -> str:
    if template is None:
        return "NULL"
    parts = [p for p in re.split(r"(\{[ksw]\})", template) if p]
    return " || ".join(["''", *(p[1] if re.fullmatch(r"\{[ksw]\}", p) else "'" + p.replace("'", "''") + "'" for p in parts)])


def _by(field: Field) -> Column:
    out = F.lit(None).cast("string")
    for i, template in enumerate(field):
        out = F.when(F.col("k") % len(field) == i, _column(template)).otherwise(out)
    return out


def rows(spark, d, fields: dict[str, Field], where: str = "true") -> DataFrame:
    """A row for each document with the fields."""
    return docs(spark, d).where(where).select(*(_by(f).alias(name) for name, f in fields.items()))


def rows_sql(fields: dict[str, Field], where: str = "true") -> str:
    cases = (f"CASE k % {len(f)} {' '.join(f'WHEN {i} THEN {_sql(t)}' for i, t in enumerate(f))} END AS {name}" for name, f in fields.items())
    return f"SELECT {', '.join(cases)} FROM {DOCS} WHERE {where}"


PIECES = {
    "slug": ["s{k}"],
    "manifest": ["title: x\nverified:\n  date: 2026-01-01\n", "title: {w}", "verified: yes", None],
    "draft": ["all anchors verified against print\n---\nBody † checked. {s}", "head {s}\n---\nBody.", "head\n---\nBody † verify this claim † (internal: confirmed) {s}", "{s} zero † markers remain\n---\n", "this is UNVERIFIED here. {s}\n---\nUNVERIFIED below", None],
}
#: Files of pieces: their fields, and which documents have one.
FILES = [
    ({"slug": ["s{k}"], "name": ["README.md"], "text": ["Nothing unverified is asserted. All 12 references were checked. {s}", "All scripture loci verified 2026-03-01.\n{s} confirm the date before print? no: zero unverified markers", "{s}", None, ""]}, "k % 5 < 4"),
    ({"slug": ["s{k}"], "name": ["notes.md"], "text": ["Please verify the quote before publishing it. {s}", "{s} and a standing caveat.\nSecond line: must be checked against the print", "x"]}, "k % 3 < 2"),
    ({"slug": ["s{k}"], "name": ["log/a.md", "log/b.md"], "text": ["the full unverified anchor ledger, {s}"]}, "k % 4 = 1"),
    ({"slug": ["s{k}"], "name": ["other.md"], "text": ["UNVERIFIED but not looked at"]}, "k % 7 = 0"),
]
MANIFESTS = {
    "slug": ["s{k}"], "type": [None, "post", "page"], "title": ["", "{w}", "{w}", "A", "B"], "title_note": ["settled 2026-09-02 (replaced the working title {w})", "working title, not yet settled", "TBD {s}", None], "subtitle": [" ", "{w}", None], "subtitle_note": [None, "proposed", "unsettled {s}"],
    "cover_caption": ["What {w} means", "An imagined scene, not a likeness", "The {w} again", "Photo by {w}"], "cover_alt": ["{w}", None, "An old {w}, seen at dawn"],
}
NOTES = {"id": ["{k}"], "note": ["{s} 1984, p. 12", "pp. 12-13 of {s}", "see ch. II {w}", "505 U.S. 833 {w}", "§ 12 holds {w}", "Qur'an 112 ({w})", "only {w}", None, "{w} 2099 and 3000", "", "{s}"]}
NAMES = {"name": ["{w}", "a-{k}", "The-{k}", "a--{k}", "-{k}", "{k}-", "", None, "{s}", "{k}"]}
COMPANIONS = {"slug": ["s{k}"], "form": ["poem", "sonnet", "letter", None], "voice": ["bard", None, "other"], "kind": ["plain", "note"], "body": ["some **bold** {w}", "see https://x.org/{k}", "{w}", " ", None, "{s}", "[{w}](y)"]}
OWN = {"slug": ["s{k}"], "title": ["{w} t"], "subtitle": ["The {k}", None]}
CLAIMS = [
    ({"slug": ["s{k}"], "title": ["{w} t", "{w} t: The {k}", "{w}  t", "“{w} t”", None, "{w} t — The {k}", "Other {k}"], "file": ["x.md", "y.md"], "line": ["{k}"]}, "true"),
    ({"slug": ["s{k}", "zz{k}"], "title": ["{w} t", "Other"], "file": ["z.md"], "line": ["1"]}, "k % 3 = 0"),
]
TITLES = {
    "id": ["{k}"],
    "text": ["# Plain {w} *(slug `walk`)*\ntext", "intro\n# {w} (The Gate)\n# Other", "## {w}", "#no space\n#   ", None, "## long-walk *(working title **{w}**)*\n- [*A {w}*](https://x.org/the-gate/)\n  (`the-gate`) and *Hill {w}* (`hill-two`)"],
    "name": ["*None {w}*", "***Deep* {w}***", "_under_ {w}", "**two** **{w}**", None, "__{w}__"],
    "form": ["poem", "letter", "poem", None],
    "body": ["one\n{w}\n\nthree\n", "one\n{w}\n\n\t\nthree  four", "", "{s}", None, "see [*The {w}*](../long-walk/README.md) and [two\nlines](pieces/x/)\n\nbroken [a](https://x.org/p/\nb)"],
}


YAML = {"source": ["y{k}"], "text": ["title: T {w}  # settled\nimages:\n  images/a{k}.png: https://x.org/{k}\n\tb: c # d\nnot a line\nempty:\nsite: true\n  lost: x\ntitle: again", "# only a remark\n  nested: without block", None, "tags: [a, b]\nurl: https://x.org/{k}\nurl : twice\nurl: thrice"]}
LOCI = {
    "id": ["{k}"],
    "text": [
        "{w} Luke 15:18-19 and Lk 15:28; {w} (15:28–29). And 22:17 is none.", "Matthew {w}, as it has it (15:18).", "Matthew 15:18; {w} (15:18–19) and (99:1).", "*Gita* 4.7, Gita XII, Song 99, *Song*, 1885 and Gita 2.3-5 {w}", "1 John 4:19 {w} is not John 4:19", None, "Luke 15:18 then {w} Luke 15:18–20",
    ],
}
#: The loci of each of those texts: section, chapter, verse, end.
FOUND_LOCI = {0: [("Luke", 15, 18, 19), ("Luke", 15, 28, 29)], 2: [("Matthew", 15, 18, 19)], 3: [("gita", 4, 7, 7), ("gita", 12, 0, 0), ("gita", 2, 3, 5)], 4: [("1 John", 4, 19, 19), ("John", 4, 19, 19)], 6: [("Luke", 15, 18, 20)]}


def words(spark, d) -> DataFrame:
    """(k, a): the first words, in small letters, of documents that have twelve or more among their first characters."""
    return docs(spark, d).select("k", F.split(F.lower("w"), " ").alias("a")).where(F.size("a") >= 12)


WORDS = f"(SELECT k, string_split(lower(w), ' ') AS a FROM {DOCS} WHERE len(string_split(lower(w), ' ')) >= 12)"


def files(spark, d) -> DataFrame:
    out = None
    for fields, where in FILES:
        some = rows(spark, d, fields, where)
        out = some if out is None else out.unionByName(some)
    return out


def claims(spark, d) -> DataFrame:
    first, second = (rows(spark, d, fields, where) for fields, where in CLAIMS)
    return first.unionByName(second).withColumn("line", F.col("line").cast("long"))


SQL = {
    "p": f"p AS ({rows_sql(PIECES)})",
    "f": f"f AS ({' UNION ALL '.join(rows_sql(*x) for x in FILES)})",
    "m": f"m AS ({rows_sql(MANIFESTS)})",
    "n": f"n AS ({rows_sql(NOTES)})",
    "names": f"n AS ({rows_sql(NAMES)})",
    "companions": f"c AS ({rows_sql(COMPANIONS)})",
    "own": f"o AS ({rows_sql(OWN)})",
    "claims": f"c AS (SELECT slug, title, file, line::BIGINT AS line FROM ({' UNION ALL '.join(rows_sql(*x) for x in CLAIMS)}))",
    "titles": f"t AS ({rows_sql(TITLES)})",
    "yaml": f"y AS ({rows_sql(YAML)})",
}
