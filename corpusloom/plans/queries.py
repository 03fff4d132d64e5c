"""Registered queries of the library's own operators, each over its whole tables.

Where the driver's tables have no such content (tags, manifests, schedules), others stand in for it: the operator is the
same, the subject is not."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import alignment, checks, html, reconcile, text
from corpusloom.operators.quotes import quote_verdicts as verdicts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leak_shingles(spark, d):
    """FZ15: 12-word runs that documents share with benchmark items."""
    return text.leaked(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


def furniture_runs(spark, d):
    """AG6: masked three-word runs on a fiftieth of a source's documents or more."""
    return text.furniture(table(spark, d, "documents"), "source", "doc_id", share=0.02)


def furniture_removed(spark, d):
    """FZ16: words left of each document without its source's furniture."""
    docs = table(spark, d, "documents")
    left = text.without_furniture(docs, text.furniture(docs, "source", "doc_id", share=0.02), "source", "doc_id")
    return left.select("doc_id", F.sha2("text", 256).alias("left_sha256"))


def doc_digests(spark, d):
    """Short digests of documents."""
    return table(spark, d, "documents").select("doc_id", norm.short_digest(F.col("text")).alias("h"))


def chunk_digests(spark, d):
    """AG10: a document's digest over its lines, each followed by a record separator."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.array_join(F.split("text", "\n"), "\x1e"), F.lit("\x1e")), 256).alias("digest"))


def source_text_digests(spark, d):
    """N5 for benchmark items, which hold ASCII or are decomposed."""
    return table(spark, d, "benchmark").select("item_id", norm.source_text(F.col("text")).alias("normal"))


def _streams(spark, d):
    return table(spark, d, "documents").select("doc_id", norm.source_text(F.col("text"), ascii_only=True).alias("stream"))


def _runs_of_items(spark, d, n: int):
    """Whole benchmark items as runs of n words, the last of up to 2n - 1: (span_id, span)."""
    words = F.filter(F.split(norm.source_text(F.col("text"), ascii_only=True), " "), lambda w: w != "")
    items = table(spark, d, "benchmark").select("item_id", words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(1), F.floor(F.size("w") / n)).cast("int")
    runs = F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.when(k == last, F.slice("w", n * k - (n - 1), F.size("w"))).otherwise(F.slice("w", n * k - (n - 1), F.lit(n))), " "))
    return items.select("item_id", F.posexplode(runs).alias("no", "span")).select(F.concat_ws(":", "item_id", "no").alias("span_id"), "span")


def exact_phrase_search(spark, d):
    """FZ1, WN10: where benchmark items occur in documents, every hit with its context: whole items, as runs of eight words."""
    return text.phrase_hits(_streams(spark, d), _runs_of_items(spark, d, 8).withColumnRenamed("span", "phrase"), "doc_id", "span_id")


def phrase_locator_asof(spark, d):
    """JN7: the 40-line block of each document's longest line."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    starts = lines.select("doc_id", "line", F.length("content").alias("n"), (F.sum(F.length("content") + 1).over(reconcile.Window.partitionBy("doc_id").orderBy("line")) - F.length("content") - 1).alias("at"))
    longest = starts.groupBy("doc_id").agg(F.max_by("at", F.struct("n", -F.col("line"))).alias("at"))
    return text.located(longest, text.line_blocks(docs, "doc_id"), "doc_id").withColumn("at", F.col("at").cast("long"))


def links_by_host(spark, d):
    """PJ24, SO1: distinct links of pages by host."""
    found = table(spark, d, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("link"))
    host = F.regexp_extract("link", r"^https?://([^/?#]+)", 1)
    return found.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


def html_block_counts(spark, d):
    """PJ13: opening block tags of pages."""
    n = lambda tag: F.regexp_count("html", F.lit(f"(?i)<{tag}[ >]")).cast("long")
    return table(spark, d, "pages").select("page_id", n("p").alias("p"), n("h2").alias("h2"), n("li").alias("li"))


def page_reader_text(spark, d):
    """Pages as reader text."""
    return table(spark, d, "pages").select("page_id", F.sha2(norm.reader_text(F.col("html")), 256).alias("sha256"))


RULES = {"verdict": r"\b(that is|this is)\b", "of_the": r"\bof the\b", "from": r"\bfrom (a|an|the)\b"}


def lint_hits(spark, d):
    """FL4: rule hits by sentence."""
    return text.rule_hits(table(spark, d, "documents"), "doc_id", RULES)


def lint_term_threshold(spark, d):
    """FL4: rule hits without rules that a document matches three times or more."""
    return text.rule_hits(table(spark, d, "documents"), "doc_id", RULES, suppress_at=3)


def sentence_stats(spark, d):
    """PJ22: sentences of each document and the longest's length."""
    s = norm.sentences(F.col("text"), "plain")
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


def title_like_lines(spark, d):
    """FL1: documents' first lines that look like titles."""
    first = F.substring_index("text", "\n", 1)
    return table(spark, d, "documents").select("doc_id", text.looks_like_title(first).alias("title_like"))


def _vocabulary(spark):
    return spark.createDataFrame([("F", "1-URGENT"), ("F", "2-HIGH"), ("O", "1-URGENT"), ("O", "9-NEVER")], "publication string, tag string")


def _tags(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("publication"), F.col("o_orderpriority").alias("tag"))


def tag_usage(spark, d):
    """AG1: uses of a vocabulary's tags (order priorities by status stand in)."""
    return reconcile.tag_usage(_tags(spark, d), _vocabulary(spark), ["publication", "tag"])


def tag_unknown(spark, d):
    """JN2: tags in use that the vocabulary lacks."""
    return reconcile.unknown_tags(_tags(spark, d), _vocabulary(spark), ["publication", "tag"])


def required_missing(spark, d):
    """JN4: customers of a nation without an order of a status that the nation requires."""
    owners = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("group"))
    wanted = spark.createDataFrame([(i, s) for i in range(25) for s in ("F", "O") if i % 2 or s == "F"], "group long, status string")
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    return reconcile.required_missing(owners, wanted, held, "c_custkey", "status")


def fk_ownership(spark, d):
    """JN1: customers whose nation is not among those of regions 0 to 2."""
    return reconcile.orphans(table(spark, d, "customer"), table(spark, d, "nation").where("n_regionkey < 3"), "c_nationkey", "n_nationkey").select("c_custkey", "c_nationkey")


def index_losses(spark, d):
    """JN16: documents with a label that a bundle of one in three documents lacks."""
    live = table(spark, d, "labels").select("doc_id")
    return reconcile.index_losses(live, table(spark, d, "documents").where("doc_id % 3 <> 0"), ["doc_id"])


def publication_conflicts(spark, d):
    """JN16: documents whose source and language, as owners, differ between two states."""
    docs = table(spark, d, "documents")
    other = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "moved").when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    return reconcile.ownership_conflicts(docs, other, ["doc_id"], "source")


def _objects(docs, changed: bool):
    body = F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("!"))).when(F.col("doc_id") % 5 == 2, F.reverse("text")).otherwise(F.col("text")) if changed else F.col("text")
    return docs.select(F.concat(F.lit("d/"), "doc_id").alias("key"), F.md5(body).alias("md5"), F.octet_length(body).cast("long").alias("size"))


def upload_plan(spark, d):
    """SK5: actions that bring a store with altered, absent and stale objects up to date."""
    docs = table(spark, d, "documents")
    return reconcile.upload_plan(_objects(docs.where("doc_id % 11 <> 3"), False), _objects(docs.where("doc_id % 11 <> 5"), True))


def _line_hashes(docs, keep: str, edit: str):
    body = F.when(F.expr(edit), F.concat("line", F.lit(" edited"))).otherwise(F.col("line"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return lines.where(keep).select("doc_id", "idx", norm.short_digest(body).alias("h"))


def three_way_rows(spark, d):
    """FZ10: states of lines of which drafts and live copies were edited or dropped."""
    docs = table(spark, d, "documents")
    base, draft = _line_hashes(docs, "idx % 13 <> 12", "false"), _line_hashes(docs, "idx % 11 <> 10", "doc_id % 3 = 0 AND idx % 2 = 0")
    live = _line_hashes(docs, "true", "doc_id % 3 = 0 AND idx % 3 = 0 OR doc_id % 5 = 0")
    return reconcile.three_way(base, draft, live, ["doc_id", "idx"])


def drift_status(spark, d):
    """FZ12: drift between documents and copies with other texts, other marks or none."""
    docs = table(spark, d, "documents")
    ours = docs.select("doc_id", norm.short_digest(F.col("text")).alias("h"), F.col("lang").alias("marks"))
    body = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    theirs = docs.where("doc_id % 9 <> 0").select("doc_id", norm.short_digest(body).alias("h"), F.when(F.col("doc_id") % 4 != 2, F.col("lang")).otherwise("xx").alias("marks"))
    return reconcile.drift(ours, theirs, "doc_id")


def aligned_lines(spark, d):
    """FZ9: lines of documents aligned with copies that lack a line and have another (no SQL: Ratcliff-Obershelp)."""
    lines = F.transform(F.split("text", "\n"), lambda s: F.xxhash64(s))
    docs = table(spark, d, "documents").select("doc_id", lines.alias("base"))
    docs = docs.withColumn("side", F.concat(F.slice("base", 2, 1000000), F.array(F.col("doc_id"))))
    return alignment.align(docs, "doc_id").groupBy("doc_id", "op").agg(F.count(F.lit(1)).alias("n"))


NOW = "2024-03-01 00:00:00"


def embargo_state(spark, d):
    """TM1, TM2: states of moments written with zones, regions, seconds, quotes and remarks, or without (events' times stand in)."""
    e = table(spark, d, "events")
    at = lambda form: F.date_format("ts", form)
    written = (at("yyyy-MM-dd"), F.concat(at("yyyy-MM-dd HH:mm"), F.lit(" +02:00")), F.concat(at("yyyy-MM-dd"), F.lit(" UTC")), F.lit(None).cast("string"), F.concat(F.lit('"'), at("yyyy-MM-dd HH:mm:ss"), F.lit(' America/New_York"')), F.concat(at("yyyy-MM-dd HH:mm"), F.lit(" Mars/Olympus")), F.concat(at("yyyy-MM-dd'T'HH:mm"), F.lit("Z # settled")))
    raw = F.lit(None).cast("string")
    for k, text_ in enumerate(written):
        raw = F.when(F.col("event_id") % 7 == k, text_).otherwise(raw)
    return e.select("event_id", reconcile.embargo(raw, F.to_timestamp(F.lit(NOW + " Z"), "yyyy-MM-dd HH:mm:ss VV")).alias("state"))


def moments_due(spark, d):
    """TM3: events due within two days of the median instant of January 2024."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return reconcile.due(e, "at", F.lit("2024-01-15 00:00:00").cast("timestamp"), 48).select("event_id")


def notes_backlog(spark, d):
    """TM8: states of notes by precedence (orders stand in)."""
    o = table(spark, d, "orders")
    state = reconcile.note_state(F.col("o_orderkey") % 7 == 0, F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT")
    return o.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def first_role_order(spark, d):
    """Roles of a conversation in the order of their first turns."""
    first = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    return first.select("conv_id", "role", F.row_number().over(reconcile.Window.partitionBy("conv_id").orderBy("first_turn", "role")).alias("number"))


def carry_forward(spark, d):
    """WN2, WN3: the last user turn before each assistant turn."""
    rows = text.carried(table(spark, d, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "asked")
    return rows.where("role = 'assistant'").select("conv_id", "turn", "asked")


def merge_adjacent(spark, d):
    """PJ7, WN4: adjacent turns of one role as one."""
    merged = text.merged_runs(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return merged.select("conv_id", "turn", "role", "n", F.sha2("text", 256).alias("sha256"))


def interior_gaps(spark, d):
    """FL17, WN5: gaps in the turns that are not the user's."""
    return reconcile.gaps(table(spark, d, "conversations").where("turn % 3 <> 1"), "conv_id", "turn")


def page_calibration_mode(spark, d):
    """AG7: modes of line numbers against quantities (stand-ins for pages against locators)."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.floor("l_quantity") % 5).cast("long").alias("delta"))
    return reconcile.calibration(rows, "source", "delta")


def index_upsert(spark, d):
    """SK2, SO6: an index of documents merged with a newer one."""
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 4 <> 0").select("doc_id", F.col("lang").alias("title"), F.array("source").alias("outlets"))
    new = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("lang")).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("site"), "source")).otherwise(F.array("source")).alias("outlets"))
    out = reconcile.upserted(old, new, ["doc_id"], ["title"], ["outlets"])
    return out.select("doc_id", "title", F.array_join("outlets", ",").alias("outlets"), "change")


def shelf_audit(spark, d):
    """JN14, FL15: labelled documents against files with altered and missing digests."""
    docs = table(spark, d, "documents")
    rows = table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")
    rows = rows.select(F.concat(F.lit("f"), "doc_id").alias("file"), F.when(F.col("doc_id") % 6 == 0, "0000").otherwise(F.substring(F.sha2("text", 256), 1, 12)).alias("digest"), F.when(F.col("quality") == 1, "free: ✅ to share. ⚠️ OCR.").when(F.col("doc_id") % 2 == 0, "❌ no, not ✅").when(F.col("doc_id") % 3 == 0, "book, no sharing: ok").alias("redistribution"))
    files = docs.where("doc_id % 10 <> 7").select(F.concat(F.lit("f"), "doc_id").alias("file"), F.sha2("text", 256).alias("sha256"))
    return reconcile.shelf_audit(rows, files)


def best_source_rank(spark, d):
    """FZ5: the best source of each part by status, score and run (suppliers stand in for sources)."""
    l = table(spark, d, "lineitem")  # noqa: E741
    status = F.when(F.col("l_returnflag") == "A", "MATCH").when(F.col("l_returnflag") == "N", "DRIFT").otherwise("OUT OF ORDER")
    rows = l.select("l_partkey", F.col("l_suppkey").alias("source"), status.alias("status"), F.col("l_quantity").cast("long").alias("score"), F.col("l_linenumber").cast("long").alias("run"))
    return reconcile.best_source(rows, ["l_partkey"])


def hits_per_source(spark, d):
    """AG8, WN9: the three longest documents of each source, with the source's total: a report."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return reconcile.capped(docs, ["source"], [F.desc("n_chars"), "doc_id"], 3)


def talk_minutes(spark, d):
    """AG9: words that each role speaks in a conversation, and minutes at 130 words a minute."""
    n = F.size(F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w: w != "")).cast("long")
    out = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.sum(n).alias("words"))
    return out.select("conv_id", "role", "words", F.round(F.col("words") / 130, 4).alias("minutes"))


def gate_summary(spark, d):
    """AG15: rules' states; a rule that checked nothing has not passed."""
    hits = text.rule_hits(table(spark, d, "documents"), "doc_id", RULES)
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_checked"))
    names = spark.createDataFrame([("verdict",), ("of_the",), ("from",), ("never",)], "rule string")
    checked = names.join(F.broadcast(n.withColumn("k", F.lit(1))), F.when(F.col("rule") != "never", 1) == F.col("k"), "left").select("rule", F.coalesce("n_checked", F.lit(0).cast("long")).alias("n_checked"))
    return text.findings_summary(hits, checked)


def quote_verdicts(spark, d):
    """FZ2 to FZ5: verdicts of benchmark items in whole, as runs of 12 words, the last of up to 23, against documents: as they are, with
    their halves swapped, with words left out, or with another word."""
    w, no = F.split("span", " "), F.split("span_id", ":")[1].cast("int") % 5
    join = lambda *parts: F.array_join(F.concat(*parts), " ")
    rest = lambda k: F.slice(w, k, F.lit(99))
    spans = _runs_of_items(spark, d, 12).withColumn("span", F.when(no == 1, F.concat(join(rest(7)), F.lit(" … "), join(F.slice(w, 1, 6)))).when(no == 2, join(F.slice(w, 1, 5), rest(9))).when(no == 3, join(F.slice(w, 1, 5), F.array(F.lit("another")), rest(7))).otherwise(F.col("span")))
    return verdicts(spans, _streams(spark, d), "doc_id")


def links_extract(spark, d):
    """PJ24: the distinct links of each page."""
    return table(spark, d, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("link"))


def html_marks(spark, d):
    """PJ9, PJ10, PJ13: blocks of pages with digests of their texts and marks (no SQL: nested elements)."""
    blocks = table(spark, d, "pages").select("page_id", F.posexplode(html.blocks_of(F.col("html"))).alias("idx", "b"))
    return blocks.select("page_id", "idx", "b.kind", norm.short_digest(F.col("b.text")).alias("h"), norm.short_digest(html.mark_keys(F.col("b.marks"))).alias("hm"), F.size("b.marks").alias("marks"))


def ocr_garbled_docs(spark, d):
    """FL2: documents whose normalized words are mostly no words."""
    return _streams(spark, d).select("doc_id", checks.garbled(F.col("stream")).alias("garbled"))


def content_presence(spark, d):
    """FZ13: lines that copies lack; some copies have lost their first line, some documents have no copy."""
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    page = F.when(F.col("doc_id") % 3 == 0, F.array_join(F.slice(F.split("text", "\n"), 2, 1 << 30), "\n")).otherwise(F.col("text"))
    return checks.content_presence(lines, docs.where("doc_id % 7 <> 0").select("doc_id", page.alias("page")), "doc_id")


def tag_unused(spark, d):
    """JN2, SO3: entries of the vocabulary that nothing uses."""
    return reconcile.index_losses(_vocabulary(spark), _tags(spark, d), ["publication", "tag"])


def tags_in_order(spark, d):
    """ST2: customers' order priorities in a vocabulary's order, unknown ones last in the order of the orders."""
    used = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("tag"), F.col("o_orderkey").alias("pos"))
    out = checks.ordered_tags(used, spark.createDataFrame([("2-HIGH", 0), ("1-URGENT", 1)], "tag string, ord int"), "o_custkey")
    return out.select("o_custkey", F.array_join("tags", ",").alias("tags"))


def deck_compare(spark, d):
    """FZ18, JN17: conversations as decks against copies that lack slides or have other texts; half have keys."""
    c = table(spark, d, "conversations")
    key = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("k"), "turn"))
    ours = c.select("conv_id", F.col("turn").alias("n"), key.alias("key"), "role", "text")
    theirs = ours.where("NOT (conv_id % 5 = 0 AND n = 2)").withColumn("text", F.when(F.expr("conv_id % 3 = 0 AND n = 1"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return checks.deck_compare(ours, theirs, "conv_id", ["role", "text"])


def resolved_rows(spark, d):
    """XT3, FZ10: states of documents after decisions for drafts or live copies."""
    edited = lambda k, x: F.md5(F.when(F.col("doc_id") % k == 0, F.concat("text", F.lit(x))).otherwise(F.col("text")))
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("base"), edited(2, "d").alias("draft"), edited(3, "l").alias("live"))
    taken = docs.where("doc_id % 5 < 2").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "draft").otherwise("live").alias("take"))
    out = checks.resolved(docs, taken, ["doc_id"])
    return out.select("doc_id", reconcile.classify(F.col("base"), F.col("draft"), F.col("live")).alias("state"))


def deferrals_lapsed(spark, d):
    """TM10: labelled documents whose text has changed since, or that are gone."""
    docs = table(spark, d, "documents")
    held = table(spark, d, "labels").select("doc_id").join(docs, "doc_id").select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha"))
    return checks.lapsed(held, docs.where("doc_id % 9 <> 0").select("doc_id", F.sha2("text", 256).alias("sha")), "doc_id")


def furniture_top(spark, d):
    """AG17, ST4: the six most frequent furniture runs of each source: a report."""
    found = text.furniture(table(spark, d, "documents"), "source", "doc_id", share=0.02)
    return reconcile.capped(found, ["source"], [F.desc("on_pages"), "run"], 6).select("source", "run", "on_pages", "total")


def superseded_lines(spark, d):
    """FL10: lines of each document that hold one of two words (stand-ins for retired, superseded)."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(checks.superseded(F.col("line"), ["from", "old"])).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def landed_on_not_found(spark, d):
    """FL16: pages whose address holds a marker."""
    return table(spark, d, "pages").select("page_id", checks.not_found(F.col("url"), ["/404", "/en/", "not-found"]).alias("lost"))


QUERIES = {
    f.__name__: f
    for f in (
        leak_shingles, furniture_runs, furniture_removed, doc_digests, chunk_digests, source_text_digests, exact_phrase_search, phrase_locator_asof, links_by_host,
        html_block_counts, page_reader_text, lint_hits, lint_term_threshold, sentence_stats, title_like_lines, tag_usage, tag_unknown, required_missing, fk_ownership,
        index_losses, publication_conflicts, upload_plan, three_way_rows, drift_status, aligned_lines, embargo_state, moments_due, notes_backlog, first_role_order,
        carry_forward, merge_adjacent, interior_gaps, page_calibration_mode, index_upsert, shelf_audit, best_source_rank, hits_per_source, talk_minutes, gate_summary, quote_verdicts,
        links_extract, html_marks, ocr_garbled_docs, content_presence, tag_unused, tags_in_order, deck_compare, resolved_rows, deferrals_lapsed, furniture_top, superseded_lines,
        landed_on_not_found,
    )
}
