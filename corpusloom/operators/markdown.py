"""Markdown drafts: published body, blocks, inline marks, footnotes, reader text, quoted spans, addresses and titles.

Column functions work within a row; DataFrame functions take (key, text). A null text has no blocks, notes, spans or addresses."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators.text import let

#: The kind of a block by how it begins, first match first; all else is a paragraph.
KINDS = ((r"\A---\z", "hr"), (r"\A### ", "h3"), (r"\A## ", "h2"), (r"\A!\[", "figure"), (r"\A[-*]\s", "ul"), (r"\A> ", "blockquote"))
#: What a block after a note may begin with without being taken for a lost continuation of it.
NO_CONTINUATION = r"\A(---|#|>|[-*+]\s|!\[|\|)"
#: A date of the desk, or words of consultation with a date, do not belong into a published text.
CLEARANCE = r"(?i)\b20\d\d-\d\d-\d\d\b|\b(?:consulted|accessed|retrieved)\s+(?:on\s+)?(?:\d|20\d\d|[A-Z][a-z]+ \d)"
#: Addresses in their three forms, and the marks of prose that may follow a bare one.
INLINE_URL, AUTO_URL, BARE_URL = r"\]\((https?://[^)\s]+)\)", r"<(https?://[^>\s]+)>", r"(?<![(<\[])\b(https?://[^\s<>()\[\]]+)"
TRAILING = r"[.,;:!?'\"*_`]+$"
WRAPPED_URL = r"\]\(\s*https?://[^)]*?\n[^)]*?\)"
DEFINITION = r"(?s)\A\[\^(\w+)\]:\s?(.*)\z"
EMPTY = "array<string>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def published(text: Column) -> Column:
    """SC3, PJ17: the body below the first line `---`, or the whole text if there is none, without comments."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return stripped(F.regexp_replace(bare, r"(?s)\A(?:.*?\n)??[ \t\r]*---[ \t\r]*(?:\n|\z)", ""))


def without_daggers(text: Column) -> Column:
    """Notes after a dagger, as far as their line goes, are not published."""
    return F.regexp_replace(text, "†[^\n]*", "")


def raw_blocks(body: Column) -> Column:
    """PJ1: parts between blank lines, those without text left out; indentation is kept."""
    return F.filter(F.split(body, r"\n[ \t]*\n"), lambda b: b.rlike(r"(?U)\S"))


def block_kind(block: Column) -> Column:
    """PJ2."""
    kind = F.lit("p")
    for pattern, name in reversed(KINDS):
        kind = F.when(block.rlike(pattern), name).otherwise(kind)
    return kind


def inline(text: Column, images: Column | None = None, captions: Column | None = None) -> Column:
    """PJ3: a block's text as HTML: entities, escaped marks kept as they are, note references as [[FNx]], figures (their files
    mapped by `images`, their captions by `captions`), links, bold, italics."""
    marks = {"*": "\x01A", "_": "\x01U", "[": "\x01L", "]": "\x01R"}
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def swapped(t: Column, pairs: list[tuple[str, str]], sign: str) -> Column:
        done = t
        for a, b in pairs:
            done = F.replace(done, F.lit(a), F.lit(b))
        return F.when(F.contains(t, F.lit(sign)), done).otherwise(t)

    out = let(out, lambda t: swapped(t, [("\\" + mark, parked) for mark, parked in marks.items()], "\\"))
    out = F.regexp_replace(out, r"\[\^(\w+)\]", "[[FN$1]]")
    picture = r"!\[(.*?)\]\((.*?)\)"

    def figure(found: Column) -> Column:
        alt = F.replace(F.regexp_extract(found, picture, 1), F.lit('"'), F.lit("&quot;"))
        file = F.regexp_extract(found, picture, 2)
        source = F.coalesce(images[file], file) if images is not None else file
        said = captions[file] if captions is not None else F.lit(None).cast("string")
        said = F.when(F.coalesce(said, F.lit("")) != "", F.concat(F.lit("<figcaption>"), said, F.lit("</figcaption>"))).otherwise("")
        return F.concat(F.lit('<figure><img src="'), source, F.lit('" alt="'), alt, F.lit('">'), said, F.lit("</figure>"))

    # A lambda's variables are computed once, what stands outside of it wherever it is named.
    out = let(out, lambda t: F.when(F.contains(t, F.lit("![")), F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(picture), F.lit(0))), t, lambda done, found: F.replace(done, found, figure(found)))).otherwise(t))
    out = F.regexp_replace(out, r"\[([^\[\]]+?)\]\(([^)]+?)\)", '<a href="$2">$1</a>')
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"\*(.+?)\*", "<em>$1</em>")
    return let(out, lambda t: swapped(t, [(parked, mark) for mark, parked in marks.items()], "\x01"))


def render_block(block: Column, images: Column | None = None, captions: Column | None = None, kind: Column | None = None) -> Column:
    """PJ2: one stripped block as HTML; a quotation of several parts holds a paragraph for each. kind: the block's kind, if it is known."""
    own = lambda text: inline(text, images, captions)
    tag = lambda name, text: F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))
    lines = F.regexp_replace(F.regexp_replace(block, r"[ \t]*\n[ \t]*", "\n"), r"\n(?![-*]\s)", " ")
    items = F.transform(F.split(lines, "\n"), lambda item: tag("li", own(F.regexp_replace(item, r"\A[-*]\s+", ""))))
    paragraphs = F.filter(F.split(block, r"\n\s*\n"), lambda q: stripped(q) != "")
    quoted = F.transform(paragraphs, lambda q: tag("p", own(F.replace(F.regexp_replace(q, r"(?m)^>[ \t]?", ""), F.lit("\n"), F.lit(" ")))))
    kind = block_kind(block) if kind is None else kind
    return (
        F.when(kind == "hr", "<hr>")
        .when(kind == "h3", tag("h3", own(F.substring(block, F.lit(5), F.length(block)))))
        .when(kind == "h2", tag("h2", own(F.substring(block, F.lit(4), F.length(block)))))
        .when(kind == "figure", own(block))
        .when(kind == "ul", tag("ul", F.array_join(items, "")))
        .when(kind == "blockquote", tag("blockquote", F.array_join(quoted, "")))
        .otherwise(tag("p", own(F.replace(block, F.lit("\n"), F.lit(" ")))))
    )


def clean_note(raw: Column) -> Column:
    """PJ6: (text, removed) of a note: a tail after a dagger and a last sentence that asks for verification are removed."""
    text = F.regexp_replace(raw, r"(?s)\s*[†‡].*\z", "")
    text = stripped(F.regexp_replace(text, r"(?s)\s*\bVerify\b[^.]*\.\s*\z", ""))
    tail = F.when(raw.rlike("[†‡]"), F.regexp_extract(raw, r"(?s)[†‡](.*)\z", 1)).otherwise(F.substring(stripped(raw), F.length(text) + 1, F.length(raw)))
    return F.struct(text.alias("text"), F.when(text != stripped(raw), stripped(tail)).otherwise("").alias("removed"))


def parsed(docs: DataFrame, key: str) -> DataFrame:
    """PJ1, PJ4: a row (key, idx, part, label, src, kind) for each block: `body`, `note` (a definition), `more` (an indented block
    that continues the note before it) or `orphan` (a paragraph right after a note, which may be a lost continuation)."""
    rows = docs.select(key, F.posexplode(raw_blocks(published(F.col("text")))).alias("idx", "raw"))
    bare = F.when(F.concat(F.substring("raw", 1, 1), F.substring("raw", -1, 1)).rlike(r"(?U)\s"), stripped(F.col("raw"))).otherwise(F.col("raw"))
    rows = rows.select(key, "idx", bare.alias("src"), F.col("raw").rlike(r"\A(?: {4,}|\t)\S").alias("indented"))
    # Readers of bodies and of notes need all of these columns, so that texts are split and dealt once for both.
    rows = rows.repartition(key)
    label, indented = F.when(F.col("src").startswith("[^"), F.regexp_extract("src", DEFINITION, 1)).otherwise(""), F.col("indented")
    defines = (label != "") & ~indented
    order = Window.partitionBy(key).orderBy("idx")
    # The last block that is not indented: the label of a definition, or nothing.
    opened = F.last(F.when(~indented, F.when(defines, label).otherwise("")), ignorenulls=True).over(order)
    rows = rows.withColumns({"label": F.coalesce(F.when(defines, label).when(indented, opened), F.lit("")), "defines": defines})
    rows = rows.withColumn("part", F.when(F.col("defines"), "note").when(F.col("label") != "", "more").otherwise("body"))
    lost = F.lag("part").over(order).isin("note", "more") & ~F.col("src").rlike(NO_CONTINUATION)
    rows = rows.withColumn("part", F.when((F.col("part") == "body") & F.coalesce(lost, F.lit(False)), "orphan").otherwise(F.col("part")))
    return rows.select(key, "idx", "part", "label", "src", F.when(F.col("part").isin("body", "orphan"), block_kind(F.col("src"))).alias("kind"))


def body_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """PJ7: (key, idx, kind, src) of the body, neighbouring quotations as one; definitions between them do not part them."""
    body = blocks.where("part IN ('body', 'orphan')")
    order = Window.partitionBy(key).orderBy("idx")
    joins = (F.col("kind") == "blockquote") & F.coalesce(F.lag("kind").over(order) == "blockquote", F.lit(False))
    rows = body.withColumn("__first", F.sum(F.when(joins, 0).otherwise(1)).over(order))
    merged = rows.groupBy(key, "__first").agg(F.min("idx").alias("idx"), F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("idx", "src"))).alias("all"))
    return merged.select(key, "idx", "kind", F.array_join(F.transform("all", lambda x: x["src"]), "\n\n").alias("src"))


def notes(blocks: DataFrame, key: str) -> DataFrame:
    """PJ4, PJ6, PJ19: (key, label, raw, text, removed) of each note, its continuations included; of a label that is defined twice
    the last definition counts."""
    own = blocks.where("part IN ('note', 'more')")
    number = F.sum(F.when(F.col("part") == "note", 1).otherwise(0)).over(Window.partitionBy(key).orderBy("idx"))
    body = norm.collapsed(F.when(F.col("part") == "note", F.regexp_extract("src", DEFINITION, 2)).otherwise(F.col("src")))
    own = own.withColumns({"__no": number, "raw": body}).withColumn("clean", clean_note(F.col("raw")))
    joined = own.groupBy(key, "label", "__no").agg(F.array_sort(F.collect_list(F.struct("idx", "raw", "clean"))).alias("all"))
    texts = F.filter(F.transform("all", lambda x: x["clean"]["text"]), lambda t: t != "")
    gone = F.filter(F.transform("all", lambda x: x["clean"]["removed"]), lambda t: t != "")
    joined = joined.select(key, "label", "__no", F.array_join(F.transform("all", lambda x: x["raw"]), " ").alias("raw"), F.array_join(texts, " ").alias("text"), F.array_join(gone, " ").alias("removed"))
    last = F.struct("raw", "text", "removed")
    return joined.groupBy(key, "label").agg(F.max_by(last, "__no").alias("x")).select(key, "label", "x.*")


def references(body: DataFrame, key: str) -> DataFrame:
    """WN1: (key, label, at, refs): the first reference to each label in the body, and how many there are."""
    found = body.select(key, "idx", F.posexplode(F.regexp_extract_all("src", F.lit(r"\[\^(\w+)\]"), F.lit(1))).alias("pos", "label"))
    return found.groupBy(key, "label").agg(F.min(F.struct("idx", "pos")).alias("at"), F.count(F.lit(1)).alias("refs"))


def ordered_notes(blocks: DataFrame, key: str) -> DataFrame:
    """PJ5, WN1: the notes that the body refers to, numbered from 1 by first reference."""
    # No reference crosses blocks, so quotations need not be merged to find them in order. Notes and references meet as rows of one group,
    # where they are dealt already; a join would have them split and dealt again for each side.
    own = notes(blocks, key).select(key, "label", F.struct("raw", "text", "removed").alias("x"), F.lit(None).cast("struct<idx:int,pos:int>").alias("at"))
    seen = references(blocks.where("part IN ('body', 'orphan')"), key).select(key, "label", F.lit(None).cast(own.schema["x"].dataType).alias("x"), "at")
    met = own.union(seen).groupBy(key, "label").agg(F.max("x").alias("x"), F.min("at").alias("at")).where("x IS NOT NULL AND at IS NOT NULL")
    return met.select(key, "label", "x.*", F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("number"))


def note_issues(blocks: DataFrame, key: str) -> DataFrame:
    """PJ4, PJ5: (key, label, issue): undefined, unreferenced, duplicated, nested and orphaned."""
    own, refs = notes(blocks, key), references(body_blocks(blocks, key), key)
    issue = lambda rows, name: rows.select(key, "label", F.lit(name).alias("issue"))
    nested = own.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\^(\w+)\]"), F.lit(1)))).alias("label"))
    before = F.last(F.when(F.col("part").isin("note", "more"), F.col("label")), ignorenulls=True).over(Window.partitionBy(key).orderBy("idx"))
    lost = blocks.withColumn("label", before).where("part = 'orphan'")
    out = issue(refs.join(own, [key, "label"], "left_anti"), "undefined").union(issue(own.join(refs, [key, "label"], "left_anti"), "unreferenced"))
    return out.union(issue(refs.where("refs > 1"), "duplicated")).union(issue(nested.distinct(), "nested")).union(issue(lost, "orphaned"))


def rendered(docs: DataFrame, key: str) -> DataFrame:
    """PJ8, XT6: the reader's view: (key, part, idx, html, text, h) of the body's blocks and of the notes in the order of their
    references, without dividers and empty blocks; `divided` tells that a divider stands before a block."""
    return _labelled(docs, key).select(key, "part", "idx", "html", "text", "h", "divided")


def _labelled(docs: DataFrame, key: str) -> DataFrame:
    """The reader's view, with the labels of notes."""
    blocks = parsed(docs, key)
    body = body_blocks(blocks, key).withColumn("html", render_block(F.col("src"), kind=F.col("kind"))).withColumn("text", norm.reader_text(F.col("html")))
    # Texts are made below the window, as a filter on them would be pushed beneath and make them twice.
    order, shown = Window.partitionBy(key).orderBy("idx"), (F.col("kind") != "hr") & (F.col("text") != "")
    divided = F.coalesce(F.lag("kind").over(order) == "hr", F.lit(False))
    place = F.sum(shown.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    body = body.withColumns({"divided": divided, "at": place.cast("int")}).where(shown)
    body = body.select(key, F.lit("body").alias("part"), F.col("at").alias("idx"), "html", "text", "divided", F.lit(None).cast("string").alias("label"))
    fns = ordered_notes(blocks, key).withColumn("html", inline(F.col("text")))
    fns = fns.select(key, F.lit("fns").alias("part"), (F.col("number") - 1).alias("idx"), "html", norm.reader_text(F.col("html")).alias("text"), F.lit(False).alias("divided"), "label")
    # Readers' texts are collapsed already.
    return body.union(fns).select(key, "part", "idx", "html", "text", F.substring(F.sha2(norm.flat_quotes(F.col("text")), 256), 1, 16).alias("h"), "divided", "label")


def stray_marks(body: DataFrame) -> DataFrame:
    """FL12: body blocks (idx, src) whose rendered text still shows asterisks that were not escaped, or that holds a single backtick beside
    a letter, with how many asterisks there are."""
    shown = F.regexp_count(norm.reader_text(render_block(F.col("src"))), F.lit(r"\*")) - F.regexp_count("src", F.lit(r"\\\*"))
    ticks = F.regexp_count("src", F.lit("`"))
    return body.withColumns({"stars": shown, "tick": (ticks % 2 == 1) & F.col("src").rlike(r"`\w|\w`")}).where("stars > 0 OR tick")


def residual(rows: DataFrame) -> DataFrame:
    """FL7: rendered rows (html) that still hold a date of the desk or ask for verification; what an image shows is exempt."""
    seen = F.regexp_replace("html", r'\salt="[^"]*"', ' alt=""')
    asks = (F.col("part") == "fns") & F.col("html").rlike("(?i)verify")
    return rows.where(asks | seen.rlike(CLEARANCE))


def internal_stripped(blocks: DataFrame, key: str) -> DataFrame:
    """PJ18: (key, text): the Markdown body with the notes cleaned of internal remarks; a note of which nothing is left goes."""
    kept = clean_note(norm.collapsed(F.regexp_extract("src", DEFINITION, 2)))["text"]
    more = clean_note(norm.collapsed(F.col("src")))["text"]
    line = F.when(F.col("part") == "note", F.when(kept != "", F.concat(F.lit("[^"), F.col("label"), F.lit("]: "), kept))).when(F.col("part") == "more", F.when(more != "", F.concat(F.lit("    "), more))).otherwise(F.col("src"))
    rows = blocks.withColumn("line", line).where("line IS NOT NULL")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n\n").alias("text"))


def publishable_paragraphs(text: Column, least: int = 40) -> Column:
    """PJ17: a draft's paragraphs of at least so many characters, as a page should show them."""
    body = F.regexp_replace(F.regexp_replace(without_daggers(published(text)), r"(?s)```.*?```", " "), r"!\[[^\]]*\]\([^)]*\)", " ")
    body = F.regexp_replace(body, r"(?ms)^\[\^[\w-]+\]:.*?(?=\n\s*\n|\z)", "")
    body = F.regexp_replace(F.regexp_replace(body, r"\[\^[\w-]+\]", ""), r"\[([^\]]+)\]\([^)]*\)", "$1")
    parts = F.transform(F.split(F.regexp_replace(body, r"[*_`>#]+", ""), r"\n\s*\n"), norm.page_text)
    return F.filter(parts, lambda p: F.length(p) >= least)


def blanked(text: Column, pattern: str) -> Column:
    """The matches of a pattern as spaces of the same length."""
    return F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), text, lambda done, found: F.replace(done, found, F.repeat(F.lit(" "), F.length(found))))


def quoted_spans(text: Column, least: int = 12) -> Column:
    """PJ20: (span, stop) of italic runs and then of runs in double quotes of at least so many characters; titles in links and
    bold runs are no quotations. `stop` is the position after the closing mark."""
    clear = blanked(blanked(text, r"\[\*[^*]+\*\]\([^)]*\)"), r"\*\*[^*]+\*\*")

    def found(clear: Column, pattern: str, marks: str) -> Column:
        # Matches part the text; the lengths of what stands before each add up to its place.
        hits, between = F.regexp_extract_all(clear, F.lit(pattern), F.lit(1)), F.split(clear, pattern)
        placed = F.transform(hits, lambda hit, i: F.struct(hit.alias("span"), (F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda n, s: n + F.length(s)) + F.aggregate(F.slice(hits, 1, i + 1), F.lit(0), lambda n, s: n + F.length(s) + 2)).alias("stop")))
        return F.filter(placed, lambda x: F.length(x["span"]) >= least)

    return let(clear, lambda c: F.concat(found(c, r"\*([^*]+)\*", "*"), found(c, r"[\"“]([^\"”]+)[\"”]", '"')))


def locus_spans(text: Column, least: int = 12) -> Column:
    """PJ21: italic runs, then quoted runs of the text without emphasis, of at least so many characters, each once by its
    normal form for verses."""
    clear = F.regexp_replace(text, r"\[\*[^*]+\*\]\([^)]*\)", " ")
    runs = F.concat(F.regexp_extract_all(clear, F.lit(rf"\*([^*]{{{least},}})\*"), F.lit(1)), F.regexp_extract_all(F.regexp_replace(clear, r"[*_]+", ""), F.lit(rf"[“\"]([^”\"]{{{least},}})[”\"]"), F.lit(1)))
    keyed = F.transform(runs, lambda r, i: F.struct(F.lower(F.regexp_replace(r, r"[^A-Za-z0-9]+", " ")).alias("k"), i.alias("i"), r.alias("r")))
    # Sorted by form and place, the first of a form is the one whose neighbour before has another.
    first = lambda s: F.filter(s, lambda x, j: (F.trim(x["k"]) != "") & ((j == 0) | (F.get(s, j - 1)["k"] != x["k"])))
    placed = F.transform(let(F.array_sort(keyed), first), lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r")))
    return F.transform(F.array_sort(placed), lambda x: x["r"])


def spans_by_note(paragraphs: DataFrame, key: str) -> DataFrame:
    """JN5: (key, para, label, span): each quoted span of a paragraph goes to the first note reference at or after its end, else
    to the paragraph's last; paragraphs without a reference have none."""
    pattern = r"\[\^([\w-]+)\]"
    labels, between = F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.split("text", pattern)
    marks = F.transform(labels, lambda label, i: F.struct((F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda n, s: n + F.length(s)) + F.aggregate(F.slice(labels, 1, i), F.lit(0), lambda n, s: n + F.length(s) + 3)).alias("at"), label.alias("label")))
    rows = paragraphs.select(key, "para", marks.alias("marks"), F.explode(quoted_spans(F.col("text"))).alias("x")).where(F.size("marks") > 0)
    after = F.filter("marks", lambda m: m["at"] >= F.col("x.stop") - 1)
    return rows.select(key, "para", F.coalesce(F.get(after, F.lit(0)), F.element_at("marks", -1))["label"].alias("label"), "x.span")


def urls(text: Column) -> Column:
    """PJ24, SO1: the distinct addresses of links, autolinks and bare ones, without marks of prose at their ends."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (INLINE_URL, AUTO_URL, BARE_URL)])
    return F.array_distinct(F.filter(F.transform(every, lambda u: F.regexp_replace(u, TRAILING, "")), lambda u: u != ""))


def unrenderable(text: Column) -> Column:
    """PJ24: addresses of the body that readers would see as text: autolinks and bare ones that no link has too."""
    body = published(text)
    naked = F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in (AUTO_URL, BARE_URL)])
    return F.array_except(F.filter(F.transform(naked, lambda u: F.regexp_replace(u, TRAILING, "")), lambda u: u != ""), F.regexp_extract_all(body, F.lit(INLINE_URL), F.lit(1)))


def has_wrapped_url(text: Column) -> Column:
    """PJ25: a link whose address is broken over two lines."""
    return text.rlike(WRAPPED_URL)


def image_files(text: Column, hero: Column | None = None, listed: Column | None = None) -> Column:
    """PJ26: the distinct files under images/ of the hero, a list and the body, in this order."""
    own = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))
    first = F.array(hero) if hero is not None else F.array().cast(EMPTY)
    every = F.concat(first, F.coalesce(listed, F.array().cast(EMPTY)) if listed is not None else F.array().cast(EMPTY), own)
    plain = F.transform(F.filter(every, lambda f: f.isNotNull()), lambda f: F.regexp_replace(f, r"\A(?:\.{1,2}/)+", ""))
    return F.array_distinct(F.filter(plain, lambda f: f.startswith("images/")))


def stanzas(text: Column, form: Column) -> Column:
    """PJ31: the parts of a text between blank lines; a poem keeps its lines, any other form flows."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), stripped), lambda p: p != "")
    return F.when(form == "poem", parts).otherwise(F.transform(parts, norm.collapsed))


def h1_title(text: Column) -> Column:
    """PJ32: the first heading of the first level without a remark in italic brackets at its end; null if there is none."""
    title = F.regexp_replace(F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1)), r"\s*\*\(.*\z", "")
    return F.when(F.trim(title) != "", F.trim(title))


def unemphasized(text: Column) -> Column:
    """PJ33: a text without the marks of emphasis around the whole of it, up to three deep."""
    out = F.trim(text)
    for _ in range(3):
        out = F.trim(F.regexp_replace(out, r"(?s)\A(\*\*\*|\*\*|\*|__|_)(.+?)\1\z", "$2"))
    return out


#: How prose names a piece: a heading with its title, an emphasized title before the slug, a link to its folder.
HEAD_LABEL = r"(?m)^##\s+([A-Za-z0-9][A-Za-z0-9._-]*)\s*\*\((?:working\s+)?title\s+(?:\*\*([^*]+)\*\*|\"([^\"]+)\")\s*\)\*"
INDEX_LABEL = r"(?<![\w*])(\*{1,3})([^*`\n]{2,120}?)\1(?:\]\([^)\s]*\))?[ \t]*(?:\n[ \t]*)?\(\s*`([A-Za-z0-9][A-Za-z0-9._-]*)`"
PIECE_LINK = r"\[([^\]]{2,120})\]\(([^)]*?pieces/|\.\./)([A-Za-z0-9][A-Za-z0-9._-]*)/(?:README\.md)?\)"


def title_claims(text: Column) -> Column:
    """PJ33: distinct (slug, title) that a text claims in one of three forms."""
    of = lambda pattern, slug, title: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, slug).alias("slug"), norm.title_text(unemphasized(title(m, pattern))).alias("title")))
    head = of(HEAD_LABEL, 1, lambda m, p: F.concat(F.regexp_extract(m, p, 2), F.regexp_extract(m, p, 3)))
    index = of(INDEX_LABEL, 3, lambda m, p: F.regexp_extract(m, p, 2))
    link = of(PIECE_LINK, 3, lambda m, p: F.regexp_extract(m, p, 1))
    return F.array_distinct(F.concat(head, index, link))


def article(docs: DataFrame, key: str) -> DataFrame:
    """XT7: (key, part, idx, html) of the reader's view for a place without notes: the cover (the first block, if it is a figure)
    left out, references as numbers in brackets, figures numbered from 1 (`figure`)."""
    numbers = F.collect_list(F.when(F.col("part") == "fns", F.struct("label", (F.col("idx") + 1).cast("string").alias("number")))).over(Window.partitionBy(key))
    rows = _labelled(docs, key).withColumn("numbers", F.map_from_entries(numbers))
    rows = rows.where("NOT (part = 'body' AND idx = 0 AND startswith(html, '<figure>'))")
    labels = F.array_distinct(F.regexp_extract_all("html", F.lit(r"\[\[FN(\w+)\]\]"), F.lit(1)))
    html = F.aggregate(labels, F.col("html"), lambda done, label: F.replace(done, F.concat(F.lit("[[FN"), label, F.lit("]]")), F.concat(F.lit("["), F.coalesce(F.try_element_at("numbers", label), F.lit("0")), F.lit("]"))))
    shown = F.col("html").startswith("<figure>").cast("int")
    figure = F.when(shown == 1, F.sum(shown).over(Window.partitionBy(key, "part").orderBy("idx")))
    return rows.select(key, "part", "idx", html.alias("html"), figure.cast("int").alias("figure"))


def edited_source(src: Column, old: Column, new: Column) -> Column:
    """PJ27, PJ28: (text, note): a block's Markdown with an edit of its reader's text applied to the runs that differ, marks left
    alone. The result is rendered again; if readers would not see `new`, the edit is refused with a null text."""
    import pandas as pd

    from corpusloom.operators.places import edited

    @F.pandas_udf("string")
    def run(srcs: pd.Series, olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([edited(*x) for x in zip(srcs, olds, news, strict=True)], dtype=object)

    made = run(src, old, new)
    seen = norm.flat_quotes(norm.reader_text(render_block(made)))
    right = F.coalesce(seen == norm.flat_quotes(new), F.lit(False))
    return F.struct(F.when(right, made).alias("text"), F.when(right, F.when(old == new, "no change").otherwise("verified")).when(made.isNull(), "not mapped").otherwise("not as expected").alias("note"))
