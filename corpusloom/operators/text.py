"""Shingles, furniture, search, links, blocks and prose rules: DataFrame in, DataFrame out."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import norm


#: Characters of a short phrase that streams are searched by, phrases that a stream is probed for in its own row, and short ones
#: that it is scanned for one by one.
GRAM, PROBES, SCANNED = 12, 4096, 256


def let(value: Column, body) -> Column:
    """body(value), with value computed once for the row: a lambda would compute what stands outside it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(words: Column, n: int) -> Column:
    """WN6: the runs of n words of an array, joined by a space; none if there are fewer words."""
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")))


def exploded_shingles(docs: DataFrame, key: str, n: int) -> DataFrame:
    """A row (key, shingle) for each distinct shingle of a document."""
    with_words = docs.select(key, norm.words(F.col("text")).alias("words"))
    return with_words.select(key, F.explode(F.array_distinct(shingles(F.col("words"), n))).alias("shingle"))


def shingle_hashes(words: Column, n: int) -> Column:
    """The distinct runs of n words of an array as 64-bit hashes: a hash of each word, then of each run of them."""
    return let(words, lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n))))).otherwise(F.array().cast("array<long>")))


def leaked(private: DataFrame, public: DataFrame, private_key: str, public_key: str, n: int = 12, inherited: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """FZ15: how many n-word runs public texts share with private ones. Runs of `inherited` (shingle) are allowed, and those
    whose sha1 is in `known` (sha1) have been accepted before. Runs meet by one 64-bit hash, which is all that moves of a public text;
    then each pair's private runs are looked for in the words of its public text, so that a hash that two runs share counts
    for nothing. A text's distinct runs are found in time linear in its words."""
    text_words = lambda c: norm.words(F.col(c))
    own = private.select(F.col(private_key).alias("__a"), F.explode(F.array_distinct(shingles(text_words("text"), n))).alias("shingle"))
    if inherited is not None:
        own = own.join(inherited.select("shingle").distinct(), "shingle", "left_anti")
    if known is not None:
        own = own.withColumn("sha1", F.sha1("shingle")).join(known.select("sha1").distinct(), "sha1", "left_anti")
    own = own.select("__a", "shingle", F.xxhash64(F.split("shingle", " ")).alias("h"))
    theirs = public.select(F.col(public_key).alias("__b"), F.explode(shingle_hashes(text_words("text"), n)).alias("h"))
    met = theirs.join(own, "h").groupBy("__b").agg(F.collect_list(F.struct("__a", "shingle")).alias("runs"))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    # Words are made again for the few texts that met.
    checked = met.join(public.select(F.col(public_key).alias("__b"), "text"), "__b").withColumn("words", padded(F.array_join(text_words("text"), " ")))
    held = checked.select("__b", F.explode(F.filter("runs", lambda r: F.contains("words", padded(r["shingle"])))).alias("r"))
    return held.groupBy(F.col("__b").alias(public_key), F.col("r.__a").alias(private_key)).agg(F.count_distinct("r.shingle").alias("shared"))


def _masked_words(text: Column) -> tuple[Column, Column]:
    """A text's words, and the same masked: at once for the whole text, as neither case nor digits make or end a word."""
    flat = F.regexp_replace(F.trim(text), r"\s+", " ")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return words(flat), words(norm.masked(flat))


def _run_starts(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def _run_hash(words: Column, at: Column, n: int) -> Column:
    """The hash of the array of n words from `at`, without making one."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(n)])


def furniture(pages: DataFrame, group: str, page: str, n: int = 3, share: float = 0.5, least_pages: int = 4) -> DataFrame:
    """AG6, FZ16: masked n-word runs on max(2, int(share * pages)) pages of a group or more; groups of fewer than
    `least_pages` pages have none. Runs are counted by a 64-bit hash first, which is on as many pages as any run of it; only those that
    are on enough pages are counted themselves. Up to PROBES of them are told in the page's own row."""
    masked = pages.select(group, _masked_words(F.col("text"))[1].alias("words"))
    hashed = lambda w: F.array_distinct(F.transform(_run_starts(w, n), lambda i: _run_hash(w, i, n)))
    totals = pages.groupBy(group).agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least_pages)
    cut = F.greatest(F.lit(2), F.floor(F.col("pages") * share).cast("long"))
    enough = lambda counts: counts.join(totals, group).where(F.col("on_pages") >= cut)
    count = F.count(F.lit(1)).alias("on_pages")
    hashes = enough(masked.select(group, F.explode(let(F.col("words"), hashed)).alias("__h")).groupBy(group, "__h").agg(count)).select(group, "__h").persist()
    few = [r[0] for r in hashes.select("__h").distinct().limit(PROBES + 1).collect()]
    if len(few) <= PROBES:
        hashes.unpersist()
        told = let(F.col("words"), lambda w: F.transform(F.filter(_run_starts(w, n), lambda i: _run_hash(w, i, n).isin(few)), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))
        runs = masked.select(group, F.explode(F.array_distinct(told)).alias("run"))
    else:
        runs = masked.select(group, F.explode(F.array_distinct(shingles(F.col("words"), n))).alias("run")).withColumn("__h", F.xxhash64(F.split("run", " "))).join(hashes, [group, "__h"])
    return enough(runs.groupBy(group, "run").agg(count)).select(group, "run", "on_pages", "pages")


def without_furniture(pages: DataFrame, found: DataFrame, group: str, page: str, n: int = 3) -> DataFrame:
    """FZ16: the pages' texts without the words that a furniture run covers; the positions left are found by one difference of
    sets. Up to PROBES runs are told in the page's own row; words meet more by an equi-join on the run's hash."""
    words, masked = _masked_words(F.col("text"))
    wanted = found.select(group, "run").distinct().persist()
    # A group's length tells it from the run that follows.
    keyed = lambda run: F.concat(F.length(F.col(group).cast("string")).cast("string"), F.lit(":"), F.col(group).cast("string"), run)
    few = wanted.select(keyed(F.col("run")).alias("k"), F.xxhash64(F.split("run", " ")).alias("h")).limit(PROBES + 1).collect()
    none = F.array().cast("array<int>")
    if len(few) <= PROBES:
        wanted.unpersist()
        keys, hashes = [r.k for r in few], [r.h for r in few]
        starts = let(masked, lambda w: F.filter(_run_starts(w, n), lambda i: _run_hash(w, i, n).isin(hashes) & keyed(F.array_join(F.slice(w, i + 1, n), " ")).isin(keys)))
        out = pages.select(group, page, words.alias("words"), starts.alias("starts"))
    else:
        hashed = F.transform(shingles(masked, n), lambda r: F.struct(F.xxhash64(r).alias("h1"), F.xxhash64(F.lit(n), r).alias("h2")))
        runs = pages.select(group, page, F.posexplode(hashed).alias("at", "run")).select(group, page, "at", "run.h1", "run.h2")
        hits = runs.join(wanted.select(group, F.xxhash64("run").alias("h1"), F.xxhash64(F.lit(n), "run").alias("h2")), [group, "h1", "h2"]).groupBy(group, page).agg(F.collect_set("at").alias("starts"))
        out = pages.select(group, page, words.alias("words")).join(hits, [group, page], "left")
    covered = F.coalesce(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (n - 1))))), none)
    every = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(none)
    kept = F.transform(F.array_except(every, covered), lambda i: F.get("words", i))
    return out.select(group, page, F.array_join(kept, " ").alias("text"))


def places(stream: Column, phrase: Column) -> Column:
    """The 0-based places of a phrase in a stream, each beginning after the last one's end, by a fold over the parts between them."""
    parts = F.split(stream, F.regexp_replace(phrase, r"([^\p{L}\p{N}\s])", r"\\$1"), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda a, part: F.struct((a["at"] + F.length(part) + F.length(phrase)).alias("at"), F.concat(a["all"], F.array(a["at"] + F.length(part))).alias("all"))
    return let(parts, lambda p: F.aggregate(F.slice(p, 1, F.size(p) - 1), start, step, lambda a: a["all"]))


def holding(streams: DataFrame, phrases: DataFrame, key: str, phrase_key: str) -> DataFrame:
    """(__k, stream, __p, phrase): the normalized streams (`stream`) that hold each phrase as a substring, whole words or not. A phrase
    of three words or more has whole words inside; candidates share the first of those, up to six, by hash. Shorter phrases, a
    query set, are scanned for where there are SCANNED at most, else share the hash of a run of characters, as long as the phrase
    or GRAM. Up to PROBES phrases are met in the stream's own row, which is read once and never moves. Of more, a stream's
    candidates are gathered, so that it moves once. Empty phrases and null streams hold nothing."""
    cleaned = phrases.where(F.trim("phrase") != "").select(F.col(phrase_key).alias("__p"), "phrase", F.split("phrase", " ").alias("w"))
    inner = F.greatest(F.least(F.size("w") - 2, F.lit(6)), F.lit(0))
    cleaned = cleaned.withColumn("n", F.when(inner > 0, inner).otherwise(-F.least(F.length("phrase"), F.lit(GRAM))))
    probe = F.when(F.col("n") > 0, F.xxhash64(F.slice("w", 2, F.abs("n")))).otherwise(F.xxhash64(F.substring("phrase", F.lit(1), F.abs("n"))))
    cleaned = cleaned.withColumn("h", probe).drop("w")
    texts = streams.select(F.col(key).alias("__k"), "stream")
    sizes = sorted(r.n for r in cleaned.select("n").distinct().collect())  # six and GRAM at most
    if not sizes:
        return texts.select("__k", "stream", F.lit(None).cast(dict(phrases.dtypes)[phrase_key]).alias("__p"), F.lit("").alias("phrase")).limit(0)
    few = len(cleaned.select("h").limit(PROBES + 1).collect()) <= PROBES
    short = [(r.h, r.phrase) for r in cleaned.where("n < 0").select("h", "phrase").distinct().limit(SCANNED + 1).collect()]
    scanned = short if few and len(short) <= SCANNED else []
    wanted = {n: [r.h for r in cleaned.where(F.col("n") == n).select("h").distinct().limit(PROBES + 1).collect()] for n in sizes}

    def met(stream: Column, n: int) -> Column:
        size = F.lit(abs(n))
        joined = (lambda w, i: F.slice(w, i, size)) if n > 0 else (lambda w, i: F.array_join(F.slice(w, i, size), ""))
        parts = F.split(stream, " ") if n > 0 else F.filter(F.split(stream, ""), lambda c: c != "")
        every = let(parts, lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(joined(w, i)))).otherwise(F.array().cast("array<long>")))
        return F.filter(every, lambda h: h.isin(wanted[n])) if len(wanted[n]) <= PROBES else every

    def candidates(stream: Column) -> Column:
        found = [met(stream, n) for n in sizes if n > 0 or not scanned]
        if scanned:
            probes = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(phrase).alias("phrase")) for h, phrase in scanned])
            found.append(F.transform(F.filter(probes, lambda p: F.contains(stream, p["phrase"])), lambda p: p["h"]))
        return F.array_distinct(F.concat(*found))

    # The stream is made once for the row: a filter on it would make it again.
    of_row = F.filter(F.transform(F.array("stream"), lambda s: F.struct(s.alias("stream"), candidates(s).alias("hs"))), lambda x: F.size(x["hs"]) > 0)
    rows = texts.select("__k", F.inline(of_row))
    if few:
        # PROBES phrases at most.
        pairs = rows.select("__k", "stream", F.explode("hs").alias("h")).join(F.broadcast(cleaned.select("h", "__p", "phrase")), "h")
        return pairs.where(F.contains("stream", F.col("phrase"))).select("__k", "stream", "__p", "phrase")
    pairs = rows.select("__k", F.explode("hs").alias("h")).join(cleaned, "h").groupBy("__k").agg(F.collect_list(F.struct("__p", "phrase")).alias("phrases"))
    found = pairs.join(texts, "__k").select("__k", "stream", F.inline("phrases"))
    return found.where(F.contains("stream", F.col("phrase")))


def phrase_hits(streams: DataFrame, phrases: DataFrame, key: str, phrase_key: str, around: int = 60) -> DataFrame:
    """FZ1: every place where phrases occur in normalized streams (`stream`) as substrings, whole words or not, each hit
    beginning after the last one's end: `at` (0-based, code points) and `context`, the hit with up to `around` characters
    before and after it. A stream moves on only as its hits' contexts. Empty phrases and null streams have no hits. Only what is
    in the streams counts: marks in phrases are no patterns."""
    start = lambda at: F.greatest(at - around, F.lit(0))
    context = lambda at: F.substring("stream", start(at) + 1, at + F.length("phrase") + around - start(at))
    hits = F.transform(places(F.col("stream"), F.col("phrase")), lambda at: F.struct(at.alias("at"), context(at).alias("context")))
    rows = holding(streams, phrases, key, phrase_key).select("__k", "__p", F.inline(hits))
    return rows.select(F.col("__k").alias(key), F.col("__p").alias(phrase_key), "at", "context")


def held_phrases(streams: DataFrame, phrases: DataFrame, key: str, phrase_key: str) -> DataFrame:
    """JN10: (key, phrase_key): which phrases streams hold, wherever and however often."""
    return holding(streams, phrases, key, phrase_key).select(F.col("__k").alias(key), F.col("__p").alias(phrase_key)).distinct()


def line_blocks(docs: DataFrame, key: str, lines: int = 40) -> DataFrame:
    """SC12: blocks of so many lines; the locator is the first line's number, and `start` the offset of the block."""
    split = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "content"))
    sized = split.withColumn("start", F.coalesce(F.sum(F.length("content") + 1).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return sized.where(F.col("line") % lines == 0).select(key, (F.col("line") + 1).alias("locator"), "start")


def located(hits: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """JN7: the last block that starts at or before each hit's position (0-based `at`): an as-of join by key."""
    events = hits.select(key, "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("locator")).unionByName(blocks.select(key, F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("locator").cast("long").alias("locator")))
    asof = F.last("locator", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("locator", asof).where("kind = 1").select(key, "at", "locator")


def links(html: Column) -> Column:
    """PJ24: the distinct addresses of anchors, without trailing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r'href="([^"#]+)"'), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")))


def blocks(docs: DataFrame, key: str) -> DataFrame:
    """PJ1, PJ2: the blocks of Markdown bodies with their kinds, in order."""
    parts = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", "")), lambda b: b != "")
    rows = docs.select(key, F.posexplode(parts).alias("idx", "src"))
    kind = F.lit("p")
    for pattern, name in ((r"^> ", "blockquote"), (r"^[-*]\s", "ul"), (r"^!\[", "figure"), (r"^## ", "h2"), (r"^### ", "h3"), (r"^---$", "hr")):
        kind = F.when(F.col("src").rlike(pattern), name).otherwise(kind)
    return rows.withColumn("kind", kind)


def merged_runs(rows: DataFrame, key: str, order: str, kind: str, text: str, only: str | None = None, joiner: str = "\n") -> DataFrame:
    """PJ7, WN4: adjacent rows of one kind as one row (only: of that kind alone), texts joined in order."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.col(kind) == F.lag(kind).over(w)
    if only is not None:
        same = same & (F.col(kind) == only)
    groups = rows.withColumn("__g", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    merged = groups.groupBy(key, "__g").agg(F.min(order).alias(order), F.first(kind).alias(kind), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(order, text))).alias("__t"))
    return merged.select(key, order, kind, "n", F.array_join(F.transform("__t", lambda x: x[text]), joiner).alias(text))


def carried(rows: DataFrame, key: str, order: str, value: Column, name: str, before: bool = True) -> DataFrame:
    """WN2, WN3: the last value that is not null, of the rows before (or up to) each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def slides(docs: DataFrame, key: str) -> DataFrame:
    """PJ12: sections (`## `) and slides (`<!-- slide: t -->`) with their lines; text before the first section is dropped."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "content"))
    section, slide = F.regexp_extract("content", r"^## (.+)$", 1), F.regexp_extract("content", r"^<!-- slide: (.+?) -->", 1)
    lines = lines.withColumns({"title": F.when(section != "", section).when(slide != "", slide), "kind": F.when(section != "", "section").when(slide != "", "slide"), "design": F.regexp_extract("content", r"^<!-- design: (.+?) -->", 1)})
    lines = lines.withColumn("slide_no", F.count("kind").over(Window.partitionBy(key).orderBy("line")))
    body = F.col("kind").isNull() & (F.trim("content") != "")
    on = F.when(body & (F.col("design") == "") & F.col("content").rlike(r"^[-*>!]"), F.struct("line", "content"))
    said = F.when(body & (F.col("design") == "") & ~F.col("content").rlike(r"^[-*>!]"), F.struct("line", "content"))
    drawn = F.when(F.col("design") != "", F.struct("line", F.col("design").alias("content")))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["content"])
    return lines.where("slide_no > 0").groupBy(key, "slide_no").agg(F.first("kind", True).alias("kind"), F.first("title", True).alias("title"), listed(on).alias("on"), listed(said).alias("notes"), listed(drawn).alias("design"))


def section_words(slides_: DataFrame, budget: DataFrame, key: str, rate: int = 130) -> DataFrame:
    """AG9: spoken words of each section of a deck (rows of slides()), the minutes that they take, and its budget (number, minutes) by the
    numeral that its title begins with, roman or arabic; no budget where the title has none."""
    spoken = F.aggregate(F.transform("notes", lambda n: F.size(F.filter(F.split(n, r"\s+"), lambda w: w != ""))), F.lit(0), lambda a, b: a + b)
    rows = slides_.withColumn("words", spoken).withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("title")), ignorenulls=True).over(Window.partitionBy(key).orderBy("slide_no")))
    sums = rows.where("section IS NOT NULL").groupBy(key, "section").agg(F.min("slide_no").alias("slide_no"), F.sum("words").alias("words"))
    numeral = F.regexp_extract("section", r"\A(\d+|[IVXLCDM]+)\b", 1)
    number = F.when(numeral.rlike(r"\A\d+\z"), numeral.try_cast("int")).otherwise(norm.roman(numeral))
    out = sums.withColumn("number", number).join(budget.select("number", F.col("minutes").alias("budget")), "number", "left")
    return out.select(key, "slide_no", "section", "words", F.round(F.col("words") / rate, 4).alias("minutes"), "budget", F.coalesce(F.col("words") / rate > F.col("budget"), F.lit(False)).alias("over"))


def rule_hits(docs: DataFrame, key: str, rules: dict[str, str], suppress_at: int | None = None) -> DataFrame:
    """FL4: sentences that match rules, with counts; a rule is a document's own habit, and not reported, if it matches there
    `suppress_at` times or more. Rules are literal patterns, so each is compiled once."""
    sentence = docs.select(key, F.posexplode(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\x01"), "\x01")).alias("no", "sentence"))
    counts = F.array(*[F.struct(F.lit(rule).alias("rule"), F.regexp_count("sentence", F.lit(pattern)).alias("hits")) for rule, pattern in rules.items()])
    hits = sentence.select(key, "no", F.inline(counts)).where("hits > 0")
    if suppress_at is None:
        return hits.select(key, "no", "rule", F.col("hits").cast("long").alias("hits"))
    total = F.sum("hits").over(Window.partitionBy(key, "rule"))
    return hits.withColumn("total", total).where(F.col("total") < suppress_at).select(key, "no", "rule", F.col("hits").cast("long").alias("hits"))


def looks_like_title(text: Column) -> Column:
    """FL1: two words of four letters or more at least, and 70 % of them capitalized."""
    long = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) >= 4)
    capital = F.filter(long, lambda w: w.rlike("^[A-Z]"))
    return (F.size(long) >= 2) & (F.size(capital) >= 0.7 * F.size(long))


def findings_summary(findings: DataFrame, checked: DataFrame, rule: str = "rule") -> DataFrame:
    """AG15: a row for each rule of `checked` (rule, n_checked): pass, fail, or not_checked if nothing was."""
    counts = findings.groupBy(rule).agg(F.count(F.lit(1)).alias("found"))
    out = checked.join(counts, rule, "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return out.select(rule, "n_checked", "found", F.when(F.coalesce("n_checked", F.lit(0)) == 0, "not_checked").when(F.col("found") > 0, "fail").otherwise("pass").alias("status"))
