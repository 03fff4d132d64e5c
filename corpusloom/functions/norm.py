"""Normalization domains as Column functions. Each is a domain of its own: texts are equal only within one of them.

Patterns use (?U) where letters and spaces of any script count."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Curly quotes and their straight forms, dashes, the ellipsis.
CURLY, STRAIGHT = "‘’“”", "''\"\""


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    # A run that is one space already stays, and most are.
    return F.trim(F.regexp_replace(text, r"(?U)(?! (?!\s))\s+", " "))


def flat_quotes(text: Column) -> Column:
    """Curly quotes straight, length kept."""
    return F.translate(text, CURLY, STRAIGHT)


def smart_quotes(text: Column) -> Column:
    """Straight quotes curly; opening at the start and after a space, a bracket, a dash or an opening quote."""
    opened = F.regexp_replace(F.regexp_replace(text, r"(?U)(?<=^|[\s(\[{/—–\-‘“'\"])\"", "“"), r"(?U)(?<=^|[\s(\[{/—–\-‘“\"])'", "‘")
    return F.translate(opened, "\"'", "”’")


def short_digest(text: Column) -> Column:
    """The first 16 digits of SHA-256 of the collapsed text with straight quotes."""
    return F.substring(F.sha2(collapsed(flat_quotes(text)), 256), 1, 16)


def marks_digest(marks: Column) -> Column:
    """N3 over marks (struct kind, text, href) joined by U+0001."""
    one = F.transform(marks, lambda m: F.concat_ws("|", m["kind"], collapsed(flat_quotes(m["text"])), F.coalesce(m["href"], F.lit(""))))
    return short_digest(F.array_join(one, "\x01"))


def _decomposed(keep_marks: bool):
    @F.pandas_udf("string")
    def decompose(text: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            s = unicodedata.normalize("NFKD", s)
            return s if keep_marks else "".join(c for c in s if not unicodedata.combining(c))

        return text.map(one, na_action="ignore")

    return decompose


def decomposed(text: Column, keep_marks: bool = False) -> Column:
    """NFKD, with or without combining marks; only texts with characters outside ASCII leave the JVM's functions."""
    wide = text.rlike(r"[^\x00-\x7F]")
    # What the condition rules out would be sent too; a null is sent in its place.
    return F.when(wide, _decomposed(keep_marks)(F.when(wide, text))).otherwise(text)


def source_text(text: Column, ascii_only: bool = False) -> Column:
    """No accents, straight quotes, dashes as spaces, lower case, a-z 0-9 and apostrophes between two of them."""
    # Double quotes and dashes are spaces with all else, so only single quotes are made straight first; translate reads letter by letter.
    straight = lambda t: F.replace(F.replace(t, F.lit("‘"), F.lit("'")), F.lit("’"), F.lit("'"))
    s = F.lower(straight(text if ascii_only else decomposed(straight(text))))
    # All but a-z, 0-9, apostrophes and spaces, in ranges: the same as an excluding class takes the regular expressions five times as long.
    s = F.regexp_replace(s, r"[\x00-\x1f!-&(-/:-`{-\x{10FFFF}]+", " ")
    s = F.regexp_replace(s, "'(?:(?![a-z0-9])|(?<![a-z0-9]'))", " ")
    return F.trim(F.regexp_replace(s, "  +", " "))


def verse_text(text: Column) -> Column:
    """Marks kept through NFKD, so that accents split words; brackets dropped, their content kept."""
    s = F.lower(F.translate(flat_quotes(decomposed(flat_quotes(text), keep_marks=True)), "[]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9' ]+", " "), " +", " "))


#: Entities that stand for themselves in reader text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: Entities of page text.
MORE_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def unescaped(text: Column, entities=ENTITIES) -> Column:
    for name, c in entities:
        text = F.replace(text, F.lit(name), F.lit(c))
    return text


def page_text(text: Column) -> Column:
    """Page text for comparison, spacing around punctuation and contractions evened out."""
    s = F.replace(F.regexp_replace(flat_quotes(text), "[—–]", "-"), F.lit("…"), F.lit("..."))
    s = collapsed(unescaped(F.regexp_replace(s, "<[^>]+>", " "), MORE_ENTITIES + ENTITIES))
    s = F.regexp_replace(F.regexp_replace(s, r" ([,.;:!?%)\]}])", "$1"), r"([(\[{]) ", "$1")
    s = F.regexp_replace(s, r"(?U)(\w) ?' ?(s|t|re|ve|ll|d|m)\b", "$1'$2")
    return F.regexp_replace(s, r"(?U)(\w)-\s+(\w)", "$1-$2")


def header_text(text: Column) -> Column:
    """N8."""
    s = F.replace(F.replace(F.replace(flat_quotes(text), F.lit("—"), F.lit("--")), F.lit("–"), F.lit("-")), F.lit("…"), F.lit("..."))
    return collapsed(s)


def title_text(text: Column) -> Column:
    """N9."""
    return collapsed(flat_quotes(text))


def reader_text(html: Column) -> Column:
    """Footnote marks, captions and tags out; three entities unescaped."""
    s = F.regexp_replace(html, r"\[\[FN[^\]]*\]\]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<figcaption>.*?</figcaption>", ""), r"<[^>]+>", "")
    return collapsed(unescaped(s))


#: Markdown marks and what is left of them.
PLAIN = ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\[\^[^\]]+\]:.*$", ""), (r"\[\^[^\]]+\]", ""), (r"(?m)^#+\s*", ""), (r"(?m)^[-*]\s+", ""), (r"[*_`>]", ""))


def plain_markdown(text: Column) -> Column:
    """Markdown as plain words."""
    for pattern, to in PLAIN:
        text = F.regexp_replace(text, pattern, to)
    return collapsed(text)


#: All but characters that NFC leaves alone wherever they stand: Latin letters and signs below U+0300, and dashes and quotes.
COMPOSABLE = "[^\\x00-\\u02FF\\u2010-\\u2027]"


def _composed():
    @F.pandas_udf("string")
    def compose(text: pd.Series) -> pd.Series:
        return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")

    return compose


def ingested(text: Column) -> Column:
    """Composed (NFC), collapsed, no space before punctuation, words joined across line-end hyphens. Only texts with
    characters that composition can touch leave the JVM's functions."""
    open_ = text.rlike(COMPOSABLE)
    text = F.when(open_, _composed()(F.when(open_, text))).otherwise(text)
    s = F.regexp_replace(collapsed(text), r" ([,.;:!?])", "$1")
    return F.regexp_replace(s, "(?U)(\\w)[-\u00ad] (\\w)", "$1$2")


def scrubbed(text: Column, furniture: str) -> Column:
    """What matches the furniture pattern as a space."""
    return F.regexp_replace(F.regexp_replace(text, "(?i)" + furniture, " "), r"\s{2,}", " ")


def without_numbers(text: Column) -> Column:
    """Standalone runs of one to four digits out."""
    return collapsed(F.regexp_replace(text, r"\b\d{1,4}\b", " "))


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


WORD = "[a-z0-9]+(?:['’][a-z]+)?"


def words(text: Column) -> Column:
    """The lower-case words of a text, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def slug(text: Column) -> Column:
    """N16."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[’']", ""), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def canonical_href(href: Column) -> Column:
    """One trailing slash off addresses that have a path."""
    slashes = F.length(href) - F.length(F.replace(href, F.lit("/"), F.lit("")))
    return F.when((slashes > 3) & href.endswith("/"), F.regexp_replace(href, "/$", "")).otherwise(href)


def canonical_image(url: Column) -> Column:
    """The original address that a transforming CDN wraps."""
    inner = F.regexp_extract(url, r"/(https?%3A%2F%2F[^/?#]+)", 1)
    return F.when(inner != "", F.url_decode(inner)).otherwise(url)


def masked(word: Column) -> Column:
    """Lower case, digits as #."""
    return F.regexp_replace(F.lower(word), r"\d+", "#")


def body_of(text: Column, missing: str = "whole") -> Column:
    """The text after front matter. missing: what a text without any is: `whole` body, no body (`none`), or an error (`fail`)."""
    has = text.rlike(r"(?s)\A---\n.*?\n---[ \t]*(\n|\z)")
    rest = F.regexp_replace(text, r"(?s)\A---\n.*?\n---[ \t]*(\n|\z)", "")
    other = {"whole": text, "none": F.lit(None).cast("string")}.get(missing)
    return F.when(has, rest).otherwise(F.raise_error(F.lit("a text has no front matter")) if other is None else other)


#: Sentence splits in use; each is a different definition.
SENTENCES = {
    "prose": r"(?<=[.!?])[*\"”\])]*\s+(?=[“\"*\[(]*[A-Z])",
    "collapsed": r"(?<=[.!?]) ",
    "status": r"(?<=[.!?:])\s+(?=[A-Z*`\[(])",
    "clauses": r"(?<=[.!?\n])",
    "plain": r"(?<=[.?!])\s+",
}


def sentences(text: Column, kind: str = "plain") -> Column:
    parts = F.split(text, SENTENCES[kind])
    return F.filter(parts, lambda s: F.trim(s) != "")


def roman(numeral: Column) -> Column:
    """The value of a roman numeral of I, V, X, L, C, D, M; null for anything else."""
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in p]), c)
    digits = F.transform(F.filter(F.split(F.upper(numeral), ""), lambda c: c != ""), value)
    total = F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, v: F.struct((a["sum"] + F.when(v < a["last"], -v).otherwise(v)).alias("sum"), v.alias("last")))
    return F.when(numeral.rlike("(?i)^[IVXLCDM]+$"), total["sum"])
