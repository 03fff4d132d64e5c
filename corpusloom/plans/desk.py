"""Queries over registries, outlets, schedules, shelves and baselines, and their DuckDB SQL. Large subjects are the driver's tables
in another role; small ones are literal rows."""

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import commonmark, desk, history, markdown, reconcile, text
from corpusloom.plans import made, pieces
from corpusloom.plans.drafts import NOTES, RENDERED, collapse, drafts
from corpusloom.plans.literals import frame, values
from corpusloom.plans.oracles import ORACLES as CORE
from corpusloom.plans.oracles import source_text
from corpusloom.sources import archive


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


OUTLETS = {"name": "string", "manifest_url_key": "string", "ord": "long", "on_schedule": "string", "reader_base": "string", "store": "boolean", "account_handle": "string", "browser": "string", "kind": "string"}
OUTLET_ROWS = [
    ("site", "site_url", 1, " Immediate ", "https://site.org/p", True, None, None, "web"), ("feed", "public_url", 2, "at_moment", "https://feed.org", None, "@Writer", None, "mail"), ("pro", "pro_url", 3, None, "https://pro.org/x/", None, "", "Work", "mail"),
    ("bare", "bare_url", 4, "immediately", None, None, None, "Home", "web"), ("second", "second_url", 5, "later", "https://second.org", None, "other", "Home", "mail"),
]
def _outlets(spark):
    return frame(spark, OUTLETS, OUTLET_ROWS)


def _now():
    return F.to_timestamp(F.lit(pieces.NOW + " Z"), "yyyy-MM-dd HH:mm:ss VV")


def tag_used_by(spark, d):
    """AG2: customers by order status and priority."""
    orders = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("slug"))
    return desk.used_by(orders, ["o_orderstatus", "o_orderpriority"], "slug").select("o_orderstatus", "o_orderpriority", F.array_join("used_by", ",").alias("used_by"))


def pieces_per_group(spark, d):
    """AG3: documents of each language."""
    return desk.per_group(table(spark, d, "documents"), "lang")


def state_tallies(spark, d):
    """AG4, AG5: states of lines of drafts and live copies, by document."""
    from corpusloom.plans.queries import three_way_rows

    return desk.tallies(three_way_rows(spark, d), "doc_id", ["unchanged", "push", "pull", "converged", "conflict", "unknown"])


def _revisions(spark, d):
    """Four revisions of each document's lines with marks, and a live copy, of which some have no marks."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), lambda s: F.md5(s)).alias("base"))
    revs = docs.select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("age"), "base")
    edited = F.transform("base", lambda h, i: F.when(F.pmod(i + F.col("age"), F.lit(4)) < F.col("age"), F.lit("x")).otherwise(h))
    marks = F.transform("base", lambda h, i: F.when(F.pmod(i, F.col("age") + 2) == 0, F.lit("m")).otherwise(F.lit("")))
    revs = revs.select("doc_id", F.concat(F.lit("r"), "age").alias("rev"), "age", F.when(F.col("age") == 3, F.slice("base", 1, 2)).otherwise(edited).alias("rows"), marks.alias("marks"))
    live = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("base")).when(F.col("doc_id") % 3 == 1, F.transform("base", lambda h, i: F.when(i % 4 == 3, F.lit("x")).otherwise(h))).otherwise(F.slice("base", 1, 2)).alias("rows"), F.when(F.col("doc_id") % 2 == 0, F.transform("base", lambda h, i: F.when(i % 3 == 0, F.lit("m")).otherwise(F.lit("")))).alias("marks"))
    return revs, live


def revision_detection(spark, d):
    """FZ11, AG11: which of four revisions of a document's lines a live copy still matches."""
    return desk.matching_revisions(*_revisions(spark, d), "doc_id").select("doc_id", "rev", "matched", F.round("score", 6).alias("score"))


def revision_history(spark, d):
    """SC21: the same from validity intervals."""
    revs, live = _revisions(spark, d)
    return history.matching(history.intervals(revs, "doc_id"), history.sizes(revs, "doc_id"), live, "doc_id").select("doc_id", "rev", "matched", F.round("score", 6).alias("score"))


def revision_intervals(spark, d):
    """SC21: how many validity intervals each document's revisions have, and how many revisions they span."""
    found = history.intervals(_revisions(spark, d)[0], "doc_id")
    return found.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("until") - F.col("since") + 1).alias("spanned"))


def locus_ranges(spark, d):
    """JN8, JN9: ranges of an order's number and four before and behind it, among the orders that a supplier's lines belong to (verses of
    a chapter)."""
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("chapter"), F.col("l_orderkey").alias("verse")).distinct()
    verses = items.withColumn("text", F.concat(F.lit("o"), "verse"))
    loci = items.where("verse % 3 = 0").select(F.struct("chapter", "verse").alias("locus"), "chapter", (F.col("verse") - 400).alias("lo"), (F.col("verse") + 400).alias("hi"))
    found = reconcile.in_range(loci, verses, ["chapter"])
    return found.select("locus.chapter", "locus.verse", "text", "verses")


def upper_medians(spark, d):
    """AG12: least, upper median and greatest length of each source's documents."""
    return desk.upper_median(table(spark, d, "documents"), "source", F.col("n_chars"))


def last_verses(spark, d):
    """AG13: the last line of each order (verses of a section), for orders of all keys."""
    items = table(spark, d, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("verse"))
    return desk.last_verses(table(spark, d, "orders").select(F.col("o_orderkey").alias("section")), items, ["section"]).select("section", F.col("last").cast("long").alias("last"))


def unbacked_megabytes(spark, d):
    """AG14: documents without a label, and their megabytes, by source."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "source", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    return desk.unbacked_megabytes(files, table(spark, d, "labels").select(F.col("doc_id").alias("file")), "source")


def newest_first(spark, d):
    """ST1: places of pieces by date, latest first, ties in their order."""
    return desk.newest_first(pieces.pieces(spark, d).select("slug", F.when(F.col("published_at") != "", F.col("published_at")).alias("published_at"), F.length("slug").alias("ord")), "published_at", "slug").select("slug", "place")


def schedule_by_moment(spark, d):
    """ST6, TM3: a schedule in the order of its instants."""
    out = desk.by_moment(pieces.pieces(spark, d), "slug", "publish_at")
    return out.select("slug", "place", F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("at"))


def ignored_files(spark, d):
    """SO7: documents that are restricted (bad quality) or already ignored."""
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file"))
    return desk.ignored(labels.where("quality = 0").select(F.col("doc_id").alias("file")), docs.where("file % 10 = 3"), docs)


def outlet_policies(spark, d):
    """TM5: which of the suppliers, as outlets, publish at once."""
    k = F.col("s_suppkey")
    said = F.when(k % 5 == 0, " Immediate ").when(k % 5 == 1, "at_moment").when(k % 5 == 2, "immediately").when(k % 5 == 3, "IMMEDIATE")
    return table(spark, d, "supplier").select(k.alias("name"), desk.outlet_policy(said).alias("policy"))


def published_dates(spark, d):
    """TM6: dates of pieces on each outlet."""
    rows = pieces.dated(spark, d).crossJoin(F.broadcast(_outlets(spark).select(F.col("name").alias("outlet"))))  # five outlets
    return rows.select("slug", "outlet", desk.published_on(F.col("published"), F.col("published_at"), F.col("outlet")).alias("date"))


def canonical_debts(spark, d):
    """TM5: immediate outlets on which a piece is not live yet."""
    return desk.canonical_debt(pieces.dated(spark, d), _outlets(spark), "slug")


def schedule_states(spark, d):
    """TM7: whether outlets that wait know of a piece's moment."""
    return desk.schedule_states(pieces.dated(spark, d), _outlets(spark), pieces.records(spark, d), "slug", _now()).distinct()


def schedule_guards(spark, d):
    """XT16: requests to record a schedule."""
    return desk.schedule_guards(pieces.requests(spark, d), pieces.dated(spark, d), _outlets(spark), "slug")


def lease_states(spark, d):
    """TM9: ages of leases at the last event (events stand in)."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("since"), F.when(F.col("event_type") != "error", F.col("event_type") == "click").alias("live"))
    return desk.lease_states(e.withColumn("since", F.col("since").cast("timestamp")), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").cast("timestamp"))


def declared_outlets(spark, d):
    """JN3: declared outlets and whether the registry has them."""
    return desk.declared_outlets(pieces.pieces(spark, d), _outlets(spark), "slug")


def reader_urls(spark, d):
    """PJ36: addresses of pieces by outlet."""
    return desk.reader_urls(pieces.manifests(spark, d), _outlets(spark), "slug").select("slug", "outlet", "url")


def live_urls(spark, d):
    """PJ36: the one address of each piece."""
    return desk.live_urls(pieces.manifests(spark, d), _outlets(spark), "slug")


def derived_urls(spark, d):
    """PJ37: addresses of customers on an outlet, recorded, derived or neither."""
    k = F.col("c_custkey")
    has = lambda m, text: F.when(k % m == 0, text)
    url = desk.derived_url(has(7, F.concat(F.lit("https://rec.org/"), k)), k % 5 != 0, F.when(k % 11 != 0, F.lit("https://base.org/p/")), has(3, F.concat(F.lit("x/site"), k, F.lit("/"))), has(2, F.concat(F.lit("https://sib.org/sib"), k)), F.concat(F.lit("dir"), k), k % 4 == 0)
    return table(spark, d, "customer").select("c_custkey", url.alias("url"))


def renames(spark, d):
    """PJ38: other addresses of pieces."""
    return desk.renames(pieces.pieces(spark, d))


ALIASES = {"source": "string", "alias": "string", "weight": "long"}
ALIAS_ROWS = [("s1", "the", 40), ("s1", "and the", 60), ("s2", "of the", 80), ("s2", "in", 50), ("s3", "all rights reserved", 100), ("s4", "er th", 30), ("s5", "zzzz", 10)]


def notes_by_source(spark, d):
    """JN10: documents' first lines as notes, with the sources that they name."""
    notes = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("note"))
    return desk.notes_by_source(notes, frame(spark, ALIASES, ALIAS_ROWS), "doc_id")


def notes_by_post(spark, d):
    """JN12: notes that hold the address of a draft's link."""
    posts = spark.createDataFrame([(str(i),) for i in range(0, 40, 3)], "slug string")
    return desk.notes_by_post(drafts(spark, d), posts, "doc_id")


def same_images(spark, d):
    """JN13: documents with the bytes of another, by size and digest."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.octet_length("text").alias("size"), F.md5("text").alias("md5"))
    out = desk.same_images(docs.withColumn("file", F.col("doc_id")).where("doc_id % 2 = 0"), docs.withColumn("url", F.col("doc_id")).where("doc_id % 2 = 1"))
    return out


def unlisted_slugs(spark, d):
    """JN21: words of pages that the pages' own links do not name."""
    pages = table(spark, d, "pages")
    slugs = pages.select(F.col("page_id").cast("string").alias("outlet"), F.explode(F.array(*[F.lit(x) for x in ("https://x.org/p/the/?a=1", "https://x.org/und", "https://x.org/")])).alias("url"))
    return desk.unlisted(slugs, pages.select(F.col("page_id").cast("string").alias("outlet"), "html"))


def archive_walk(spark, d):
    """SC18: orders as an archive's pages, of which some are short and some repeat an item of the page before; each order once."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("slug"))
    page = F.floor(F.col("id") / 500).cast("int")
    items = o.withColumn("page", page).where("NOT (page % 3 = 1 AND id % 500 > 100)")
    # The last item of a full page is the first one of the next page too.
    again = items.where("id % 500 = 499").withColumn("page", F.col("page") + 1)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared.rstrip('/')}/corpusloom-pages-{uuid.uuid4().hex}"
    archive.written(items.unionByName(again.join(items.select("page").distinct(), "page", "left_semi")), path)
    return archive.walked(spark, path, "id long, slug string", "id")


def unknown_posts(spark, d):
    """JN22, SC18: orders of a status as an archive, against customers' known ones."""
    archive = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("slug"), F.when(F.col("o_orderkey") % 4 == 0, "page").alias("type"), F.col("o_orderstatus").alias("outlet"))
    pieces = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("slug"), F.lit("F").alias("outlet"))
    return desk.unknown_posts(archive.union(archive.where("id % 8 = 1")), pieces, "F")


def preview_images(spark, d):
    """PJ15: preview images of pages, by whole, rooted, relative and schemeless addresses; some pages have none."""
    k = F.col("page_id")
    meta = lambda i, *parts: F.when(k % 6 == i, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts), "html"))
    html = F.coalesce(
        meta(0, '<meta property="og:image:width" content="3"><META content=\'/a', k, '.png?x=1&amp;y=2\' property="og:image"/>'), meta(1, '<meta name="og:image" content="//cdn.org/b', k, '.png">'), meta(2, '<meta property="og:image" content="c', k, '.png">'),
        meta(3, '<meta property="og:image" content="https://y.org/d', k, '.png">'), F.when(k % 6 == 4, F.col("html")),
    )
    return table(spark, d, "pages").select("page_id", desk.preview_image(html, F.concat(F.lit("https://x.org/p"), k, F.lit("/q?z"))).alias("image"))


def page_without_template(spark, d):
    """PJ16: pages without scripts, styles, superscripts and note anchors."""
    html = F.concat("html", F.lit('<A class="x" href="#footnote-1">1</A>a<SUP>2</SUP>b'))
    return table(spark, d, "pages").select("page_id", F.sha2(desk.without_template(html), 256).alias("sha"))


def lost_images(spark, d):
    """XT1: images of live copies that drafts do not hold."""
    text = drafts(spark, d)
    shown = text.select("doc_id", F.explode(markdown.image_files(F.col("text"))).alias("file"))
    live = shown.select("doc_id", F.concat(F.lit("https://cdn.org/fetch/https%3A%2F%2Fs3.org%2F"), F.regexp_replace("file", "/", "_")).alias("src")).union(text.select("doc_id", F.lit("https://s3.org/only-live.png"))).union(text.select("doc_id", F.concat(F.lit("images/"), "doc_id", F.lit("-6.png"))))
    mapped = shown.where("doc_id % 2 = 0").select("doc_id", "file", F.concat(F.lit("https://s3.org/"), F.regexp_replace("file", "/", "_")).alias("url")).union(text.select("doc_id", F.lit("images/never.png"), F.lit("https://s3.org/only-live.png")))
    return desk.lost_images(live, text, mapped, "doc_id")


def lost_embeds(spark, d):
    """XT1: customers' orders as embeds that no manifest records."""
    o = table(spark, d, "orders")
    return desk.lost_embeds(o.select("o_custkey", F.col("o_orderpriority").alias("embed")), o.where("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderpriority").alias("embed")), "o_custkey")


def seeds(spark, d):
    """XT2: baselines of drafts as readers see them; rows of odd documents have no marks."""
    rows = markdown.rendered(drafts(spark, d), "doc_id").select("doc_id", "part", "idx", "h", F.when(F.col("doc_id") % 2 == 0, norm.short_digest(F.col("html"))).alias("hm"))
    out = desk.seeds(rows, "doc_id")
    return out.select("doc_id", F.array_join("body", ",").alias("body"), F.array_join("fns", ",").alias("fns"), F.array_join("body_marks", ",").alias("body_marks"))


def seal_verdicts(spark, d):
    """XT4: whether documents and their altered copies may be sealed."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    base = docs.select("doc_id", F.col("lang").alias("title"), F.col("source").alias("subtitle"), F.transform(F.split("text", "\n"), lambda s: F.md5(s)).alias("rows"), F.array("source").alias("marks"))
    k = F.col("doc_id") % 6
    live = base.where("doc_id % 6 <> 5").select("doc_id", F.when(k == 3, "other").otherwise(F.concat("title", F.lit(" "))).alias("title"), "subtitle", F.when(k.isin(1, 2), F.array(F.lit("x"))).otherwise(F.col("rows")).alias("rows"), F.when(k == 2, F.array(F.lit("m"))).when(k != 4, F.col("marks")).alias("marks"))
    return desk.seal_verdicts(base, live, "doc_id")


def outlet_readiness(spark, d):
    """XT11: what stands behind declared outlets."""
    return desk.outlet_readiness(pieces.pieces(spark, d), _outlets(spark), "slug", "feed").distinct()


def _shelf(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("f"), "doc_id").alias("file"), F.sha2("text", 256).alias("sha256"), "doc_id")
    k = F.col("doc_id") % 9
    recorded = F.when(k == 2, "").when(k == 3, F.lit(None)).when(k == 4, "0123").when(k == 5, F.substring("sha256", 1, 16)).otherwise(F.col("sha256"))
    rows = docs.where("doc_id % 9 <> 0").select("file", recorded.alias("digest"), F.when(k != 1, F.lit("ok")).alias("verdict"))
    return docs.where("doc_id % 9 <> 8").select("file", "sha256"), rows, docs.where("doc_id % 2 = 0").select(F.col("sha256").alias("digest"))


def shelf_push(spark, d):
    """XT12: what to push to a shelf, and why not (documents stand in for files)."""
    files, rows, shelf = _shelf(spark, d)
    return desk.shelf_plan(files, rows, shelf)


def shelf_pull(spark, d):
    """XT12: what to pull from a shelf; files of one in five differ."""
    files, rows, shelf = _shelf(spark, d)
    return desk.pull_plan(rows, files.where("file NOT LIKE '%7'").withColumn("sha256", F.when(F.col("file").endswith("5"), F.reverse("sha256")).otherwise(F.col("sha256"))), shelf)


def shelf_rehash(spark, d):
    """XT13: whole digests where prefixes fit."""
    files, rows, _ = _shelf(spark, d)
    return desk.rehashed(rows, files)


PNG = "89504E470D0A1A0A0000000049454E44AE426082"
SNAP_IMAGES = [("a", "x.png", PNG), ("a", "y.png", PNG[:-8]), ("b", "z.png", None), ("c", "x.png", PNG), ("d", "w.png", "")]


def snapshot_faults(spark, d):
    """XT14, SK9: entries and images of a snapshot that do not hold (literal rows)."""
    index = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", None), ("d", "d4")], "slug string, digest string")
    records = spark.createDataFrame([("a", "d1"), ("b", "dx"), ("c", None)], "slug string, digest string")
    images = spark.createDataFrame([(s, f, h) for s, f, h in SNAP_IMAGES], "slug string, file string, h string")
    held = images.where("h IS NOT NULL").select("file", F.unhex("h").alias("content")).distinct()
    return desk.snapshot_faults(index, records, images, held)


TALKS = {"slug": "string", "title": "string", "published_at": "string", "outlets": "array<string>", "body": "string", "tags": "array<string>"}
TALK_ROWS = [("a", "T", "2026-01-01", ["site"], "# Head\nsome *words* and [a link](u)", None), ("b", "", "x", ["site"], "y", None), ("c", "T", "x", [], "y", None), ("d", "T", "x", ["s"], " ", None), ("e", "T", "x", ["s"], "y", ["t"]), (None, "T", "x", ["s"], "y", []), ("g", "T", None, ["s"], "y", []), ("h", "T", "x", None, None, None)]


def talk_records(spark, d):
    """XT15: records of talks and what they lack (literal rows)."""
    return desk.talk_records(frame(spark, TALKS, TALK_ROWS))


ANSWERS = {"id": "long", "outlet": "string", "surface": "string", "signed_in": "boolean", "status": "long", "handle": "string", "own_page": "boolean"}
ANSWER_ROWS = [(1, "feed", "pane", True, 200, "@writer", True), (2, "feed", "chrome", True, 200, "writer", True), (3, "second", "chrome", True, 200, "writer", True), (4, "second", "chrome", False, 401, None, True), (5, "second", "chrome", False, 500, None, True), (6, "pro", "chrome", True, 200, "x", True), (7, "zz", "pane", True, 200, "x", True), (8, "feed", "elsewhere", True, 200, "x", True), (9, "feed", "pane", None, None, None, True), (10, "feed", "pane", True, 200, "", True), (11, "site", "chrome", True, 200, "x", True), (12, "feed", "pane", True, 200, "writer", False), (13, "second", "chrome", True, 200, "Other", True)]


def account_verdicts(spark, d):
    """XT10: which account a surface holds, by an ordered table (literal rows)."""
    return desk.account_verdicts(frame(spark, ANSWERS, ANSWER_ROWS), _outlets(spark), "feed")


def index_times(spark, d):
    """SK3: an index's time moves only if its entries changed: nations unchanged, regions with one renamed."""
    out = None
    for name, key, value in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        rows = table(spark, d, name).select(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
        old = rows.withColumn("value", F.when((F.col("key") == "3") & F.lit(name == "region"), "old").otherwise(F.col("value"))).withColumn("generated_at", F.lit("2026-01-01"))
        one = desk.changed_at(rows, old, F.lit("2026-02-02")).withColumn("index", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def front_matter(spark, d):
    """SK4: documents as files with front matter; empty fields left out."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("title"), F.concat(F.lit('a "b" '), "source").alias("source"), "text")
    return docs.where("text IS NOT NULL").select("doc_id", F.sha2(desk.front_matter(["title", "source"], F.col("text")), 256).alias("sha"))


def page_fragments(spark, d):
    """SK8: drafts' parts by heading."""
    return desk.fragments(drafts(spark, d), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "chunk"))), lambda x: x["chunk"]), ""), 256).alias("sha"), F.min("slug").alias("first_slug"))


def merged_fragments(spark, d):
    """SK8: fragments and parts of drafts that both were edited since their base, some parts new, some gone; headings repeat."""
    parts = desk.fragments(drafts(spark, d).where("doc_id IS NOT NULL"), "doc_id")
    of, edit = lambda k, n: F.pmod(F.col("doc_id") + F.col("no"), F.lit(k)) == n, lambda c, x: F.when(c, F.concat("chunk", F.lit(x))).otherwise(F.col("chunk")).alias("chunk")
    keys = ["doc_id", "slug", "nth"]
    ours = parts.where(~of(7, 0)).select(*keys, "ordinal", edit(of(3, 0), "ours"), F.lit(1).alias("at"))
    page = parts.where(~of(5, 0)).select(*keys, "no", edit(of(4, 0), "page"), F.pmod("doc_id", F.lit(3)).alias("at"))
    merged = desk.merged_fragments(ours, page, "doc_id", parts.select(*keys, "chunk"))
    counts = {a: F.count_if(F.col("action") == a) for a in ("add", "orphan", "same", "ingest", "keep")} | {"conflicts": F.count_if("conflict")}
    return desk.rendered_fragments(merged, "doc_id", *(n.alias(a) for a, n in counts.items())).select("doc_id", *counts, F.sha2("text", 256).alias("sha"))


def placed_findings(spark, d):
    """FZ17: anchors that documents hold once, often or never."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    word = F.get(F.split("text", " "), F.lit(2))
    made = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("no"), F.concat_ws(" ", F.get(F.split("text", " "), F.lit(0)), F.get(F.split("text", " "), F.lit(1))).alias("anchor")), F.struct(F.lit(2).alias("no"), word.alias("anchor")), F.struct(F.lit(3).alias("no"), F.lit("~~no such~~").alias("anchor")))).alias("x")).select("doc_id", "x.no", "x.anchor").where("anchor <> ''")
    return desk.placed_findings(docs.select("doc_id", "text"), made, "doc_id")


def applied_findings(spark, d):
    """FZ17: replacements in documents, the second one of what the first has put there, applied as a whole or not at all."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    w = lambda k: F.coalesce(F.get(F.split("text", " "), F.lit(k)), F.lit(""))
    finding = lambda no, anchor, to: F.struct(F.lit(no).alias("no"), anchor.alias("anchor"), F.lit(to).alias("replacement"))
    every = F.array(finding(1, F.concat(w(0), F.lit(" \n"), w(1)), "first  $1\nSECOND"), finding(2, F.lit("SECOND"), "\\third"), finding(3, F.when(F.col("doc_id") % 3 == 0, "no such").otherwise("first"), "last"))
    made = docs.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")
    return desk.applied_findings(docs, made, "doc_id").select("doc_id", F.sha2("text", 256).alias("sha"))


def replaced_outside_urls(spark, d):
    """PJ29: a token of drafts replaced outside addresses."""
    x = drafts(spark, d).select("doc_id", desk.replaced_outside_urls(F.concat("text", F.lit(" example and https://example.org/example an-example")), "example", "sample").alias("x"))
    return x.select("doc_id", "x.n", F.sha2("x.text", 256).alias("sha"))


def rewrapped_lines(spark, d):
    """PJ30: documents' first lines in lines of at most 60 characters: their number and the words kept."""
    first = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", desk.rewrapped(F.substring_index("text", "\n", 1), 60).alias("w"))
    return first.select("doc_id", F.sha2(F.regexp_replace("w", "\n", " "), 256).alias("sha"), F.array_max(F.transform(F.split("w", "\n"), lambda l: F.when(F.contains(l, F.lit(" ")), F.length(l)).otherwise(0))) <= 60).toDF("doc_id", "sha", "fits")


def changed_keys(spark, d):
    """SK6: keys of documents' fields that an edit changes."""
    docs = table(spark, d, "documents")
    before = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("old"), F.lit("x"))
    after = F.create_map(F.lit("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("zz"), F.lit("source"), F.col("source"), F.lit("new"), F.when(F.col("doc_id") % 3 == 0, F.lit("y")))
    return docs.select("doc_id", F.array_join(desk.changed_keys(before, after), ",").alias("keys"))


VOCAB = {"publication": "string", "tag": "string", "label": "string", "takes": "boolean", "ord": "long"}
VOCAB_ROWS = [("F", "1-URGENT", "Urgent", True, 2), ("F", "2-HIGH", "High", False, 1), ("F", "3-MEDIUM", "Medium", True, 0), ("O", "1-URGENT", "Now", True, 0)]


def tag_plans(spark, d):
    """XT9: customers' order priorities as tags to set."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("publication"), F.array_sort(F.collect_set("o_orderpriority")).alias("tags"))
    o = o.select("o_custkey", F.when(F.col("o_custkey") % 7 != 0, F.col("publication")).alias("publication"), F.when(F.col("o_custkey") % 2 == 0, "p").alias("post_id"), "tags")
    return desk.tag_plans(o, frame(spark, VOCAB, VOCAB_ROWS), "o_custkey")


SLIDES = {"deck": "string", "n": "long", "kind": "string", "title": "string", "on": "array<string>"}
SLIDE_ROWS = [("d", 1, "title", "A Talk", []), ("d", 2, "section", "The Way", []), ("d", 3, "slide", "Who is it?", ["x"]), ("d", 4, "slide", "Who is it", []), ("d", 5, "slide", None, ["![alt](images/fig-one.v2.png)", "said"]), ("d", 6, "slide", "", ["> quoted words here and there and on", "two"]), ("d", 7, "slide", None, []), ("d", 8, "slide", "a very long title that goes on and on beyond", []), ("e", 3, "slide", "!!!", [])]


def slide_keys(spark, d):
    """XT5: handles and labels of slides (literal rows)."""
    return desk.slide_keys(frame(spark, SLIDES, SLIDE_ROWS), "deck")


def banners(spark, d):
    """XT8: a banner set once and again on documents."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    banner = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Live as "), "doc_id"))
    once = desk.without_banner(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("> **old banner**\n\n"), "text")).otherwise(F.col("text")), banner)
    return docs.select("doc_id", F.sha2(once, 256).alias("sha"), (desk.without_banner(once, banner) == once).alias("settled"))


def page_drift(spark, d):
    """FZ12: documents against copies whose headers, texts, marks, captions or anchors differ."""
    k = F.col("doc_id") % 9
    lines = F.transform(F.split("text", "\n"), lambda s: F.md5(s))
    first = lambda a, x: F.transform(a, lambda h, i: F.when(i == 0, F.lit(x)).otherwise(h))
    base = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array(F.coalesce("lang", F.lit(""))).alias("header"), lines.alias("body"), F.array("source").alias("fns"), lines.alias("body_marks"), F.array(F.lit("m")).alias("fns_marks"), lines.alias("body_anchors"), F.array(F.lit("a")).alias("fns_anchors"), F.array(F.lit("c")).alias("captions"))
    live = base.where("doc_id % 9 <> 0").withColumns({
        "header": F.when(k == 6, F.array(F.lit("other"))).otherwise(F.col("header")), "body": F.when(k == 5, first("body", "x")).when(k == 8, F.concat("body", F.array(F.lit("x")))).otherwise(F.col("body")),
        "body_marks": F.when(k.isin(2, 5, 7, 8), first("body_marks", "x")).otherwise(F.col("body_marks")), "fns_anchors": F.when(k == 4, F.array(F.lit("b"))).otherwise(F.col("fns_anchors")), "captions": F.when(k.isin(3, 7), F.array(F.lit("d"))).otherwise(F.col("captions")),
    })
    return reconcile.page_drift(base, live, "doc_id")


def three_way_marks(spark, d):
    """FZ10: verdicts on texts and on marks of documents' lines."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    side = lambda h, m: lines.select("doc_id", "idx", F.md5(F.when(F.expr(h), F.concat("line", F.lit("x"))).otherwise(F.col("line"))).alias("h"), F.when(F.expr("doc_id % 10 <> 9"), F.when(F.expr(m), F.lit("b")).otherwise("a")).alias("hm"))
    return reconcile.three_way_marks(side("false", "false"), side("idx % 2 = 0", "idx % 3 = 0"), side("doc_id % 3 = 0", "idx % 4 = 0"), ["doc_id", "idx"])


def held_states(spark, d):
    """JN14: documents as files whose rows record one, several or no digests."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("f"), "doc_id").alias("file"), F.sha2("text", 256).alias("sha256"), "doc_id")
    k = F.col("doc_id") % 5
    # Another file's digest: every digit is the next one, so that no file begins with its own.
    other = F.translate(F.substring("sha256", 1, 4), "0123456789abcdef", "123456789abcdef0")
    digests = F.when(k == 1, F.array(other, F.substring("sha256", 1, 16))).when(k == 2, F.array(other)).when(k == 3, F.array(F.lit(""))).otherwise(F.array("sha256"))
    return reconcile.held_states(docs.where("doc_id % 7 <> 0").select("file", digests.alias("digests")), docs.where("doc_id % 11 <> 0").select("file", "sha256"))


def out_of_range(spark, d):
    """AG7: lines of orders (page citations) that are away from their supplier's mode."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source"), F.when(F.col("l_linenumber") < 6, F.col("l_suppkey") % 7).otherwise(20).cast("long").alias("delta"))
    return reconcile.out_of_range(rows, "source", "delta").select("l_orderkey", "l_linenumber", "source", "delta", "mode")


def stray_marks(spark, d):
    """FL12: drafts' blocks with marks that did not render; every fifth draft gets one."""
    docs = drafts(spark, d).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\n\nlone * star and \\* kept\n\na `tick"))).otherwise(F.col("text")))
    body = markdown.body_blocks(markdown.parsed(docs, "doc_id"), "doc_id")
    return markdown.stray_marks(body).groupBy("doc_id").agg(F.sum("stars").alias("stars"), F.count_if("tick").alias("ticks"))


def strict_marks(spark, d):
    """FL12: asterisks that a strict reading leaves in drafts' blocks (no SQL: a stack of runs)."""
    docs = drafts(spark, d).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\n\nlone * star and *closed* one, *(*a) and [x](y*) `c*`"))).otherwise(F.col("text")))
    found = commonmark.strict_marks(markdown.body_blocks(markdown.parsed(docs, "doc_id"), "doc_id"))
    return found.groupBy("doc_id").agg(F.sum("stars").alias("stars"), F.count_if("tick").alias("ticks"))


def backlog_places(spark, d):
    """TM8: the backlog of notes, oldest first (orders stand in)."""
    o = table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    notes = o.select(k.alias("slug"), day.alias("published_at"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, F.pmod(k, F.lit(3)).cast("int"))).alias("posted_at"), (F.col("o_orderpriority") == "1-URGENT").alias("drafted"), (k % 7 == 0).alias("skip"))
    return reconcile.notes_backlog(notes, F.lit("1996-01-02").cast("date"))


DECKS = {"id": "long", "text": "string"}
DECK_ROWS = [(1, "dropped\n## I. The start\none two three\n- on screen\n<!-- slide: a -->\nfour five\n## 2 Next\n<!-- design: big -->\nsix\n## No numeral\nseven eight"), (2, "## III\n" + "word " * 300), (3, None), (4, "no section")]


def section_minutes(spark, d):
    """AG9, PJ12: words of a deck's sections against their budget (literal rows)."""
    budget = spark.createDataFrame([(1, 1.0), (2, 0.001), (3, 2.0)], "number int, minutes double")
    return text.section_words(text.slides(frame(spark, DECKS, DECK_ROWS), "id"), budget, "id").select("id", "section", "words", "budget", "over")


def deck_slides(spark, d):
    """PJ12: sections and slides of decks with what is shown, said and drawn (literal rows)."""
    s = text.slides(frame(spark, DECKS, DECK_ROWS), "id")
    return s.select("id", "slide_no", "kind", "title", F.array_join("on", "|").alias("on"), F.array_join("notes", "|").alias("notes"), F.array_join("design", "|").alias("design"))


def edited_blocks(spark, d):
    """PJ27, PJ28: blocks of documents' words with marks, and edits of what readers see of them: a word within bold, the text of a link,
    nothing, and an edit of another text."""
    w = lambda i: F.get("a", F.lit(i - 1))
    src = F.concat(w(1), F.lit(" *"), w(2), F.lit("* **"), w(3), F.lit(" "), w(4), F.lit("** "), w(5), F.lit(" ["), w(6), F.lit("](https://x.org/"), F.col("k").cast("string"), F.lit(") "), w(7), F.lit("[^n]\n"), w(8))
    old = F.array_join(F.slice("a", 1, 8), " ")
    put = lambda i, x: F.concat_ws(" ", *(F.lit(x) if j == i else w(j) for j in range(1, 9)))
    k = F.col("k") % 4
    rows = made.words(spark, d).select("k", src.alias("src"), F.when(k == 3, F.concat(old, F.lit(" more"))).otherwise(old).alias("old"), F.when(k == 0, put(4, "ZZZ")).when(k == 2, put(6, "ZZZ")).otherwise(old).alias("new"))
    return rows.withColumn("x", markdown.edited_source(F.col("src"), F.col("old"), F.col("new"))).select("k", "x.text", "x.note")


QUERIES = {
    f.__name__: f
    for f in (
        tag_used_by, pieces_per_group, state_tallies, revision_detection, revision_history, revision_intervals, locus_ranges, upper_medians, last_verses, unbacked_megabytes, newest_first, schedule_by_moment, ignored_files, outlet_policies, published_dates, canonical_debts, schedule_states,
        schedule_guards, lease_states, declared_outlets, reader_urls, live_urls, derived_urls, renames, notes_by_source, notes_by_post, same_images, unlisted_slugs, unknown_posts, archive_walk, preview_images, page_without_template, lost_images, lost_embeds,
        seeds, seal_verdicts, outlet_readiness, shelf_push, shelf_pull, shelf_rehash, snapshot_faults, talk_records, account_verdicts, index_times, front_matter, page_fragments, merged_fragments, placed_findings, applied_findings,
        replaced_outside_urls, rewrapped_lines, changed_keys, tag_plans, slide_keys, banners, page_drift, edited_blocks, three_way_marks,
        held_states, out_of_range, stray_marks, strict_marks, backlog_places, section_minutes, deck_slides,
    )
}


_OUT, _PIE, _DAT, _MOMENTS, _FLD = values("o", OUTLETS, OUTLET_ROWS), pieces.PIECES, pieces.DATES, pieces.MOMENTS, pieces.FIELDS
_POLICY = "CASE WHEN lower(trim(on_schedule)) = 'immediate' THEN 'immediate' ELSE 'at_moment' END"
_DATES = f"{_PIE}, {_OUT}, {_DAT}, dd AS (SELECT p.slug, o.name AS outlet, coalesce(nullif(t.date, ''), nullif(p.published_at, '')) AS date FROM p CROSS JOIN o LEFT JOIN t ON t.slug = p.slug AND t.outlet = o.name)"
_DEBT = f"{_DATES}, db AS (SELECT slug, outlet FROM (SELECT slug, unnest(outlets) AS outlet FROM p) JOIN dd USING (slug, outlet) JOIN o ON o.name = outlet WHERE {_POLICY} = 'immediate' AND date IS NULL)"
_URLS = f"{_FLD}, {_OUT}, u AS (SELECT slug, name AS outlet, ord, regexp_replace(url, '/+$', '') AS url FROM f JOIN o ON o.manifest_url_key = f.field WHERE url <> '')"
_SHELF = r"""
dc AS (SELECT 'f' || doc_id AS file, sha256(text) AS sha, doc_id FROM documents WHERE text IS NOT NULL), fi AS (SELECT file, sha FROM dc WHERE doc_id % 9 <> 8),
ro AS (SELECT file, CASE doc_id % 9 WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '0123' WHEN 5 THEN substr(sha, 1, 16) ELSE sha END AS digest, CASE WHEN doc_id % 9 <> 1 THEN 'ok' END AS verdict FROM dc WHERE doc_id % 9 <> 0),
sh AS (SELECT DISTINCT sha AS digest FROM dc WHERE doc_id % 2 = 0)"""
_LINES = "l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: md5(s)) AS b FROM documents WHERE text IS NOT NULL)"

_STATE = "CASE WHEN {b} IS NULL OR {d} IS NULL OR {l} IS NULL THEN 'unknown' WHEN {d} = {b} AND {l} = {b} THEN 'unchanged' WHEN {l} = {b} THEN 'push' WHEN {d} = {b} THEN 'pull' WHEN {d} = {l} THEN 'converged' ELSE 'conflict' END"

ORACLES = {
    "backlog_places": """WITH n AS (SELECT o_orderkey AS slug, o_orderdate::DATE AS day, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + (o_orderkey % 3)::INTEGER END AS posted, CASE WHEN o_orderkey % 7 = 0 THEN 'skip' WHEN o_orderstatus = 'F' THEN 'posted' WHEN o_orderpriority = '1-URGENT' THEN 'drafted' ELSE 'missing' END AS state FROM orders)
SELECT slug, state, CASE WHEN state = 'missing' THEN row_number() OVER (PARTITION BY state ORDER BY day, slug) END::INTEGER AS place, coalesce(posted = DATE '1996-01-02' AND day <> DATE '1996-01-02', false) AS done_today FROM n""",
    "section_minutes": "SELECT * FROM (VALUES (1::BIGINT, 'I. The start', 5::BIGINT, 1.0::DOUBLE, false), (1, '2 Next', 1, 0.001, true), (1, 'No numeral', 2, NULL, false), (2, 'III', 300, 2.0, true)) AS v(id, section, words, budget, over)",
    "deck_slides": f"SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 'section', 'I. The start', '- on screen', 'one two three', ''), (1, 2, 'slide', 'a', '', 'four five', ''), (1, 3, 'section', '2 Next', '', 'six', 'big'), (1, 4, 'section', 'No numeral', '', 'seven eight', ''), (2, 1, 'section', 'III', '', '{'word ' * 300}', '')) AS v(id, slide_no, kind, title, \"on\", notes, design)",
    "three_way_marks": f"""WITH x AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS idx FROM documents WHERE text IS NOT NULL),
y AS (SELECT *, 0 AS b, idx % 2 = 0 AS d, doc_id % 3 = 0 AS l, CASE WHEN doc_id % 10 <> 9 THEN 'a' END AS bm, CASE WHEN doc_id % 10 <> 9 THEN CASE WHEN idx % 3 = 0 THEN 'b' ELSE 'a' END END AS dm, CASE WHEN doc_id % 10 <> 9 THEN CASE WHEN idx % 4 = 0 THEN 'b' ELSE 'a' END END AS lm FROM x)
SELECT doc_id, idx, {_STATE.format(b='b', d='d::INTEGER', l='l::INTEGER')} AS state, {_STATE.format(b='bm', d='dm', l='lm')} AS marks FROM y""",
    "held_states": """SELECT 'f' || doc_id AS file, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'unlisted' WHEN doc_id % 5 = 3 THEN 'none' WHEN doc_id % 5 = 2 THEN 'mismatch' ELSE 'match' END AS state FROM documents WHERE text IS NOT NULL AND NOT (doc_id % 11 = 0 AND doc_id % 7 = 0)""",
    "out_of_range": """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS source, CASE WHEN l_linenumber < 6 THEN l_suppkey % 7 ELSE 20 END AS delta FROM lineitem),
c AS (SELECT source, delta, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT source, delta AS mode FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, delta) AS k FROM c) WHERE k = 1),
a AS (SELECT source, mode, sum(n) AS seen, sum(n) FILTER (abs(delta - mode) <= 1) AS agree FROM c JOIN m USING (source) GROUP BY ALL)
SELECT l_orderkey, l_linenumber, source, delta::BIGINT AS delta, mode::BIGINT AS mode FROM r JOIN a USING (source) WHERE seen >= 3 AND agree >= 0.6 * seen AND abs(delta - mode) > 1""",
    "stray_marks": "SELECT doc_id, 1::BIGINT AS stars, 1::BIGINT AS ticks FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0",
    "page_drift": "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'UNREACHABLE' WHEN 1 THEN 'MATCH' WHEN 2 THEN 'DRIFT-MARKS' WHEN 3 THEN 'DRIFT-CAPTION' WHEN 4 THEN 'DRIFT-ANCHORS' ELSE 'DRIFT' END AS status FROM documents WHERE text IS NOT NULL",
    "edited_blocks": f"""WITH w AS (SELECT k, a, CASE WHEN k % 4 = 0 THEN 'ZZZ' ELSE a[4] END AS w4, CASE WHEN k % 4 = 2 THEN 'ZZZ' ELSE a[6] END AS w6 FROM {made.WORDS})
SELECT k, CASE WHEN k % 4 < 3 THEN a[1] || ' *' || a[2] || '* **' || a[3] || ' ' || w4 || '** ' || a[5] || ' [' || w6 || '](https://x.org/' || k || ') ' || a[7] || '[^n]' || chr(10) || a[8] END AS text, CASE k % 4 WHEN 1 THEN 'no change' WHEN 3 THEN 'not mapped' ELSE 'verified' END AS note FROM w""",
    "tag_used_by": "SELECT o_orderstatus, o_orderpriority, string_agg(DISTINCT o_custkey::VARCHAR, ',' ORDER BY o_custkey::VARCHAR) AS used_by FROM orders GROUP BY ALL",
    "pieces_per_group": "SELECT lang, count(*) AS pieces FROM documents GROUP BY lang",
    "revision_detection": f"""WITH {_LINES}, a AS (SELECT doc_id, b, unnest([0, 1, 2, 3]) AS age FROM l),
r AS (SELECT doc_id, age, CASE WHEN age = 3 THEN b[1:2] ELSE list_transform(b, lambda h, i: CASE WHEN (i - 1 + age) % 4 < age THEN 'x' ELSE h END) END AS rws, list_transform(b, lambda h, i: CASE WHEN (i - 1) % (age + 2) = 0 THEN 'm' ELSE '' END) AS marks FROM a),
v AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN b WHEN 1 THEN list_transform(b, lambda h, i: CASE WHEN (i - 1) % 4 = 3 THEN 'x' ELSE h END) ELSE b[1:2] END AS lr, CASE WHEN doc_id % 2 = 0 THEN list_transform(b, lambda h, i: CASE WHEN (i - 1) % 3 = 0 THEN 'm' ELSE '' END) END AS lm FROM l),
m AS (SELECT doc_id, age, len(rws) AS n, len(lr) AS ln, len(list_filter(list_zip(rws, lr), lambda z: coalesce(z[1] = z[2], false))) AS matched, coalesce(len(list_filter(list_zip(marks, lm), lambda z: coalesce(z[1] = z[2], false)))::DOUBLE / len(marks), 0) AS bonus FROM r JOIN v USING (doc_id)),
s AS (SELECT *, matched + CASE WHEN n = ln AND matched = n THEN 10000 ELSE 0 END + bonus AS score FROM m)
SELECT doc_id, 'r' || age AS rev, matched::INTEGER AS matched, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, age) AS k FROM s) WHERE k = 1""",
    "revision_intervals": f"""WITH {_LINES}, a AS (SELECT doc_id, b, unnest([0, 1, 2, 3]) AS age FROM l),
r AS (SELECT doc_id, age, CASE WHEN age = 3 THEN b[1:2] ELSE list_transform(b, lambda h, i: CASE WHEN (i - 1 + age) % 4 < age THEN 'x' ELSE h END) END AS rws, list_transform(b, lambda h, i: CASE WHEN (i - 1) % (age + 2) = 0 THEN 'm' ELSE '' END) AS marks FROM a),
p AS (SELECT doc_id, age, 'row' AS kind, unnest(rws) AS h, unnest(range(len(rws))) AS i FROM r UNION ALL SELECT doc_id, age, 'mark', unnest(marks), unnest(range(len(marks))) FROM r),
c AS (SELECT *, CASE WHEN lag(h) OVER (PARTITION BY doc_id, kind, i ORDER BY age) = h AND lag(age) OVER (PARTITION BY doc_id, kind, i ORDER BY age) = age - 1 THEN 0 ELSE 1 END AS fresh FROM p)
SELECT doc_id, kind, sum(fresh)::BIGINT AS n, count(*)::BIGINT AS spanned FROM c GROUP BY ALL""",
    "upper_medians": "SELECT source, list_min(v) AS least, v[len(v) // 2 + 1] AS median, list_max(v) AS greatest FROM (SELECT source, list_sort(list(n_chars)) AS v FROM documents WHERE n_chars IS NOT NULL GROUP BY source)",
    "last_verses": "SELECT o_orderkey AS section, coalesce(max(l_linenumber), 0)::BIGINT AS last FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_orderkey % 3 <> 0) ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "unbacked_megabytes": "SELECT source, count(*) AS files, round(sum(coalesce(octet_length(encode(text)), 0)) / 1048576, 3) AS mb FROM documents ANTI JOIN labels USING (doc_id) GROUP BY source",
    "newest_first": f"WITH {_PIE} SELECT slug, row_number() OVER (ORDER BY nullif(published_at, '') DESC NULLS LAST, slug)::INTEGER AS place FROM p",
    "schedule_by_moment": f"WITH {_PIE}, {_MOMENTS} SELECT slug, row_number() OVER (ORDER BY \"at\" NULLS LAST, slug)::INTEGER AS place, strftime(\"at\", '%Y-%m-%d %H:%M:%S') AS \"at\" FROM p LEFT JOIN w USING (slug)",
    "ignored_files": "SELECT doc_id AS file FROM documents WHERE doc_id % 10 = 3 OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "outlet_policies": "SELECT s_suppkey AS name, CASE WHEN s_suppkey % 5 IN (0, 3) THEN 'immediate' ELSE 'at_moment' END AS policy FROM supplier",
    "published_dates": f"WITH {_DATES} SELECT * FROM dd",
    "canonical_debts": f"WITH {_DEBT} SELECT * FROM db",
    "schedule_states": f"""WITH {_PIE}, {_OUT}, {_MOMENTS}, {pieces.RECORDS}, e AS (SELECT DISTINCT slug, unnest(outlets) AS outlet FROM p)
SELECT slug, outlet, CASE WHEN {_POLICY} = 'at_moment' AND "at" > TIMESTAMP '{pieces.NOW}' THEN CASE WHEN (slug, outlet) IN (SELECT (slug, outlet) FROM rec) THEN 'scheduled' ELSE 'unscheduled' END END AS state FROM e JOIN o ON o.name = outlet LEFT JOIN w USING (slug)""",
    "schedule_guards": f"""WITH {_DEBT}, {_MOMENTS}, {pieces.REQUESTS}
SELECT q.slug, q.outlet, CASE WHEN "at" IS NULL THEN 'no moment' WHEN trim(approved) = '' THEN 'no approval' WHEN {_POLICY} <> 'immediate' AND q.slug IN (SELECT slug FROM db) THEN 'canonical first' ELSE 'record' END AS verdict FROM q LEFT JOIN w ON w.slug = q.slug LEFT JOIN o ON o.name = q.outlet""",
    "lease_states": """SELECT event_id AS id, floor((epoch(TIMESTAMP '2024-01-02') - floor(epoch(ts))) / 60)::BIGINT AS age,
NOT coalesce(CASE WHEN event_type <> 'error' THEN event_type = 'click' END, false) AND floor((epoch(TIMESTAMP '2024-01-02') - floor(epoch(ts))) / 60) > 240 AS abandoned FROM events""",
    "declared_outlets": f"WITH {_PIE}, {_OUT} SELECT DISTINCT slug, outlet, outlet IN (SELECT name FROM o) AS known FROM (SELECT slug, unnest(outlets) AS outlet FROM p)",
    "reader_urls": f"WITH {_URLS} SELECT slug, outlet, url FROM u",
    "live_urls": f"WITH {_URLS}, c AS (SELECT slug, regexp_replace(url, '/+$', '') AS canonical FROM f WHERE field = 'canonical') SELECT slug, url FROM (SELECT slug, url, row_number() OVER (PARTITION BY slug ORDER BY CASE WHEN url = canonical THEN 0 ELSE 1 END, ord) AS k FROM u LEFT JOIN c USING (slug)) WHERE k = 1",
    "derived_urls": """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'https://rec.org/' || c_custkey WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN NULL
ELSE 'https://base.org/p/' || CASE WHEN c_custkey % 3 = 0 THEN 'site' || c_custkey WHEN c_custkey % 2 = 0 THEN 'sib' || c_custkey ELSE 'dir' || c_custkey END || CASE WHEN c_custkey % 4 = 0 THEN '/' ELSE '' END END AS url FROM customer""",
    "renames": f"WITH {_PIE} SELECT DISTINCT old, slug FROM (SELECT slug, trim(unnest(list_concat(coalesce(former, []), [folder]))) AS old FROM p) WHERE old <> '' AND old <> slug",
    "notes_by_post": f"WITH {NOTES}, s AS (SELECT doc_id, unnest(regexp_extract_all(text, '/p/([\\w-]+)', 1)) AS slug FROM dr) SELECT DISTINCT doc_id, slug FROM s WHERE slug::INTEGER % 3 = 0 AND slug::INTEGER < 40",
    "same_images": "SELECT a.doc_id AS file, b.doc_id AS url FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1",
    "unlisted_slugs": """WITH h AS (SELECT page_id::VARCHAR AS outlet, coalesce(array_to_string(regexp_extract_all(html, 'href="([^"]+)"', 1), ' '), '') AS hrefs FROM pages), s(slug) AS (VALUES ('the'), ('und'), ('x.org'))
SELECT outlet, slug FROM h, s WHERE NOT contains(hrefs, '/' || slug)""",
    "unknown_posts": "SELECT o_orderkey AS id, o_custkey::VARCHAR AS slug FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)",
    "preview_images": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://x.org/a' || page_id || '.png?x=1&y=2' WHEN 1 THEN 'https://cdn.org/b' || page_id || '.png' WHEN 2 THEN 'https://x.org/p' || page_id || '/c' || page_id || '.png' WHEN 3 THEN 'https://y.org/d' || page_id || '.png' END AS image FROM pages",
    "page_without_template": r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html || '<A class="x" href="#footnote-1">1</A>a<SUP>2</SUP>b', '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<a\b[^>]*href="#footnote[^"]*"[^>]*>.*?</a>', ' ', 'g'), '(?is)<sup\b.*?</sup>', ' ', 'g')) AS sha FROM pages""",
    "lost_images": f"""WITH {NOTES}, i AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '!\\[[^\\]]*\\]\\((images/[^)\\s]+)', 1)) AS file FROM dr),
v AS (SELECT doc_id, 'https://s3.org/' || replace(file, '/', '_') AS image, file FROM i UNION SELECT doc_id, 'https://s3.org/only-live.png', NULL FROM dr UNION SELECT doc_id, 'images/' || doc_id || '-6.png', NULL FROM dr)
SELECT DISTINCT v.doc_id, image FROM v JOIN dr USING (doc_id) WHERE NOT contains(dr.text, image) AND NOT (v.doc_id % 2 = 0 AND file IS NOT NULL)""",
    "lost_embeds": "SELECT DISTINCT o_custkey, o_orderpriority AS embed FROM orders WHERE (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderkey % 2 = 0)",
    "seeds": f"""WITH {RENDERED}, x AS (SELECT doc_id, part, idx, substr(sha256(trim(regexp_replace(translate(text, '‘’“”', '''''""'), '[\\s\\x0B]+', ' ', 'g'))), 1, 16) AS h, substr(sha256(trim(regexp_replace(translate(html, '‘’“”', '''''""'), '[\\s\\x0B]+', ' ', 'g'))), 1, 16) AS hm FROM rd)
SELECT doc_id, coalesce(string_agg(h, ',' ORDER BY idx) FILTER (part = 'body'), '') AS body, coalesce(string_agg(h, ',' ORDER BY idx) FILTER (part = 'fns'), '') AS fns, CASE WHEN doc_id % 2 = 0 THEN coalesce(string_agg(hm, ',' ORDER BY idx) FILTER (part = 'body'), '') END AS body_marks FROM x GROUP BY doc_id""",
    "seal_verdicts": """SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN 'unreachable' WHEN 2 THEN 'marks differ' WHEN 1 THEN 'texts differ' WHEN 3 THEN 'headers differ' WHEN 4 THEN 'sealed text' ELSE CASE WHEN lang IS NULL THEN 'sealed' ELSE 'sealed' END END AS verdict FROM documents WHERE text IS NOT NULL""",
    "outlet_readiness": f"""WITH {_PIE}, {_OUT}, e AS (SELECT slug, unnest(CASE WHEN len(outlets) > 0 THEN outlets ELSE [NULL] END) AS outlet FROM p)
SELECT DISTINCT slug, outlet, CASE WHEN outlet IS NULL THEN 'none declared' WHEN coalesce(store, false) OR outlet <> 'feed' AND coalesce(reader_base, '') <> '' AND coalesce(account_handle, '') = '' THEN 'store' WHEN coalesce(account_handle, '') <> '' THEN 'browser' ELSE 'unknown' END AS state FROM e LEFT JOIN o ON o.name = outlet""",
    "shelf_push": f"""WITH {_SHELF} SELECT file, CASE WHEN ro.file IS NULL THEN 'no row' WHEN verdict IS NULL THEN 'no verdict' WHEN coalesce(ro.digest, '') = '' THEN 'no digest' WHEN NOT starts_with(sha, ro.digest) THEN 'digest mismatch' WHEN length(ro.digest) < 64 THEN 'truncated digest'
WHEN sha IN (SELECT digest FROM sh) THEN 'present' ELSE 'push' END AS action FROM fi LEFT JOIN ro USING (file)""",
    "shelf_pull": f"""WITH {_SHELF}, g AS (SELECT file, CASE WHEN file LIKE '%5' THEN reverse(sha) ELSE sha END AS sha FROM fi WHERE file NOT LIKE '%7')
SELECT file, CASE WHEN coalesce(length(digest), 0) < 64 THEN 'unaddressed' WHEN sha = digest THEN 'held' WHEN sha IS NOT NULL THEN 'differs' WHEN digest IN (SELECT digest FROM sh) THEN 'pull' ELSE 'missing' END AS action FROM ro LEFT JOIN g USING (file)""",
    "shelf_rehash": f"""WITH {_SHELF}, c AS (SELECT file, digest, sha, CASE WHEN sha IS NULL THEN 'no file' WHEN coalesce(digest, '') = '' THEN 'filled' WHEN digest = sha THEN 'whole' WHEN starts_with(sha, digest) THEN 'completed' ELSE 'mismatch' END AS change FROM ro LEFT JOIN fi USING (file))
SELECT file, CASE WHEN change IN ('filled', 'completed') THEN sha ELSE digest END AS digest, change FROM c""",
    "snapshot_faults": "SELECT * FROM (VALUES ('b', 'digest differs'), ('d', 'no record'), ('a', 'image broken'), ('b', 'image absent'), ('d', 'image broken')) AS v(slug, fault)",
    "talk_records": f"""WITH {values('k', TALKS, TALK_ROWS)}, s AS (SELECT *, CASE WHEN slug = 'a' THEN 'Head some words and a link' ELSE trim(coalesce(body, '')) END AS plain FROM k)
SELECT slug, plain, 'sha256:' || sha256(plain) AS digest, CASE WHEN slug IS NULL THEN 'no slug' WHEN coalesce(title, '') = '' THEN 'no title' WHEN coalesce(published_at, '') = '' THEN 'no date' WHEN coalesce(len(outlets), 0) = 0 THEN 'no outlets' WHEN plain = '' THEN 'no body' WHEN coalesce(len(tags), 0) > 0 THEN 'tags' END AS problem FROM s""",
    "account_verdicts": "SELECT * FROM (VALUES (1::BIGINT, 'ok'), (2, 'wrong surface'), (3, 'other account'), (4, 'signed out'), (5, 'unclear'), (6, 'no account'), (7, 'unknown outlet'), (8, 'no surface'), (9, 'no answer'), (10, 'no handle'), (11, 'no browser'), (12, 'no answer'), (13, 'ok')) AS v(id, verdict)",
    "index_times": "SELECT '2026-01-01' AS generated_at, 'nation' AS index UNION ALL SELECT '2026-02-02', 'region'",
    "front_matter": r"""SELECT doc_id, sha256('---' || chr(10) || CASE WHEN doc_id % 3 <> 0 AND coalesce(lang, '') <> '' THEN 'title: "' || lang || '"' || chr(10) ELSE '' END || CASE WHEN source IS NULL THEN '' ELSE 'source: "a \"b\" ' || source || '"' || chr(10) END || '---' || chr(10) || chr(10) || text || chr(10)) AS sha FROM documents WHERE text IS NOT NULL""",
    "page_fragments": f"WITH {NOTES}, g AS (SELECT doc_id, text, string_split_regex(chr(10) || text, '\\n## ') AS p FROM dr) SELECT doc_id, len(p)::BIGINT AS n, sha256(text) AS sha, list_min(list_concat(['preamble'], list_transform(p[2:], lambda x: CASE WHEN regexp_matches(string_split(x, chr(10))[1], '^[a-z0-9][a-z0-9._-]*($|[ *(])') THEN regexp_extract(string_split(x, chr(10))[1], '^([a-z0-9][a-z0-9._-]*)', 1) ELSE coalesce(nullif(regexp_replace(regexp_replace(lower(string_split(x, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') END))) AS first_slug FROM g",
    "merged_fragments": rf"""WITH {NOTES}, g AS (SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS i, text FROM (SELECT doc_id, text, string_split_regex(chr(10) || text, '\n## ') AS p FROM dr)),
fr AS (SELECT doc_id, i AS no, CASE WHEN i = 0 THEN substr(part, 2) ELSE '## ' || part END || CASE WHEN i < max(i) OVER (PARTITION BY doc_id) THEN chr(10) ELSE '' END AS chunk, string_split(part, chr(10))[1] AS h FROM g),
f0 AS (SELECT doc_id, no, chunk, CASE WHEN no = 0 THEN 'preamble' WHEN regexp_matches(trim(h), '^[a-z0-9][a-z0-9._-]*($|[ *(])') THEN regexp_extract(trim(h), '^([a-z0-9][a-z0-9._-]*)', 1) ELSE coalesce(nullif(regexp_replace(regexp_replace(lower(trim(h)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') END AS slug FROM fr WHERE chunk <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY no) AS nth FROM f0),
m AS (SELECT doc_id, no, slug, nth, (doc_id + no) % 7 <> 0 AS has_a, (doc_id + no) % 5 <> 0 AS has_b, (doc_id + no) % 3 = 0 AS ea, (doc_id + no) % 4 = 0 AS eb, doc_id % 3 > 1 AS newer, chunk FROM f),
a AS (SELECT *, CASE WHEN NOT has_a THEN 'add' WHEN NOT has_b THEN 'orphan' WHEN NOT ea AND NOT eb THEN 'same' WHEN ea AND eb THEN CASE WHEN newer THEN 'ingest' ELSE 'keep' END WHEN eb THEN 'ingest' ELSE 'keep' END AS action FROM m WHERE has_a OR has_b),
t AS (SELECT *, CASE WHEN action IN ('add', 'ingest') THEN CASE WHEN eb THEN chunk || 'page' ELSE chunk END ELSE CASE WHEN ea THEN chunk || 'ours' ELSE chunk END END AS out, CASE WHEN action = 'add' THEN 1 ELSE 0 END AS late FROM a)
SELECT doc_id, count(*) FILTER (action = 'add') AS add, count(*) FILTER (action = 'orphan') AS orphan, count(*) FILTER (action = 'same') AS same, count(*) FILTER (action = 'ingest') AS ingest, count(*) FILTER (action = 'keep') AS keep, count(*) FILTER (has_a AND has_b AND ea AND eb) AS conflicts,
 sha256(string_agg(CASE WHEN ends_with(out, chr(10)) THEN out ELSE out || chr(10) END, '' ORDER BY late, no)) AS sha FROM t GROUP BY doc_id""",
    "placed_findings": r"""WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS s FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, text, 1 AS no, array_to_string(s[1:2], ' ') AS anchor FROM w UNION ALL SELECT doc_id, text, 2, s[3] FROM w UNION ALL SELECT doc_id, text, 3, '~~no such~~' FROM w),
n AS (SELECT *, array_to_string(list_transform(list_filter(string_split_regex(anchor, '\s+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '\s+') AS p FROM a WHERE anchor <> ''),
c AS (SELECT doc_id, no, p, CASE WHEN p <> '' THEN len(regexp_extract_all(text, p)) END AS n, CASE WHEN p <> '' THEN instr(text, regexp_extract(text, p)) END AS b, CASE WHEN p <> '' THEN length(regexp_extract(text, p)) END AS l FROM n)
SELECT c.doc_id, c.no, CASE WHEN c.p = '' THEN 'empty' WHEN c.n = 0 THEN 'absent' WHEN c.n > 1 THEN 'ambiguous' WHEN c.no = 2 AND o.n = 1 AND c.b < o.b + o.l AND o.b < c.b + c.l THEN 'overlaps' ELSE 'placed' END AS state FROM c LEFT JOIN c o ON o.doc_id = c.doc_id AND o.no = 1""",
    "applied_findings": r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(coalesce(string_split(text, ' ')[1], '') || ' ' || coalesce(string_split(text, ' ')[2], ''), '\s+'), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, array_to_string(list_transform(a, lambda x: regexp_escape(x)), '\s+') AS p FROM w), n AS (SELECT *, CASE WHEN p = '' THEN 0 ELSE len(regexp_extract_all(text, p)) END AS n FROM p),
t AS (SELECT doc_id, text, n, CASE WHEN n = 1 THEN replace(text, regexp_extract(text, p), 'first $1 SECOND') ELSE text END AS t1 FROM n)
SELECT doc_id, sha256(CASE WHEN n = 1 AND doc_id % 3 <> 0 AND len(regexp_extract_all(t1, 'SECOND')) = 1 AND len(regexp_extract_all(replace(t1, 'SECOND', '\third'), 'first')) = 1 THEN replace(replace(t1, 'SECOND', '\third'), 'first', 'last') ELSE text END) AS sha FROM t""",
    "replaced_outside_urls": f"""WITH {NOTES}, g AS (SELECT doc_id, text || ' example and https://example.org/example an-example' AS t FROM dr)
SELECT doc_id, list_sum(list_transform(s, lambda x: len(regexp_extract_all(x, '(?:^|[^\\w-])example(?:$|[^\\w-])'))))::INTEGER AS n, sha256(array_to_string(list_transform(list_zip(list_transform(s, lambda x: regexp_replace(x, '(^|[^\\w-])example($|[^\\w-])', '\\1sample\\2', 'g')), u), lambda z: z[1] || coalesce(z[2], '')), '')) AS sha
FROM (SELECT doc_id, string_split_regex(t, 'https?://[^\\s)>\\]]+') AS s, regexp_extract_all(t, 'https?://[^\\s)>\\]]+') AS u FROM g)""",
    "rewrapped_lines": rf"SELECT doc_id, sha256({collapse('string_split(text, chr(10))[1]')}) AS sha, true AS fits FROM documents WHERE text IS NOT NULL",
    "state_tallies": "SELECT doc_id, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("unchanged", "push", "pull", "converged", "conflict", "unknown")) + f" FROM ({CORE['three_way_rows']}) GROUP BY doc_id",
    "notes_by_source": f"WITH {values('a', ALIASES, ALIAS_ROWS)}, n AS (SELECT doc_id, {source_text('string_split(text, chr(10))[1]')} AS s FROM documents) SELECT doc_id, source, max(weight) AS score FROM n JOIN a ON contains(s, alias) GROUP BY ALL",
    "changed_keys": "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 <> 0 THEN 'lang' WHEN lang IS NULL THEN NULL END, CASE WHEN doc_id % 3 = 0 THEN 'new' END, 'old') AS keys FROM documents",
    "tag_plans": f"""WITH {values('v', VOCAB, VOCAB_ROWS)}, q AS (SELECT o_custkey, min(o_orderstatus) AS st, list_distinct(list(o_orderpriority)) AS tags FROM orders GROUP BY o_custkey),
r AS (SELECT o_custkey, CASE WHEN o_custkey % 7 <> 0 THEN st END AS publication, unnest(tags) AS tag FROM q), m AS (SELECT r.*, label, takes, ord FROM r LEFT JOIN v USING (publication, tag))
SELECT o_custkey, coalesce(string_agg(label, ',' ORDER BY ord) FILTER (takes), '') AS labels, coalesce(string_agg(tag, ',' ORDER BY ord) FILTER (NOT takes), '') AS unlabelled,
CASE WHEN any_value(publication) IS NULL THEN 'no publication' WHEN any_value(publication) NOT IN ('F', 'O') THEN 'no vocabulary' WHEN count(*) FILTER (label IS NULL) > 0 THEN 'unknown tag' WHEN o_custkey % 2 <> 0 THEN 'no post' END AS problem FROM m GROUP BY o_custkey""",
    "slide_keys": """SELECT * FROM (VALUES ('d', 1::BIGINT, 'title', 'Title'), ('d', 2, 'sec-the-way', 'The Way'), ('d', 3, 'who-is-it', 'Who is it?'), ('d', 4, 'who-is-it-2', 'Who is it'), ('d', 5, 'fig-fig-one.v2', 'fig-one.v2'), ('d', 6, 'line-quoted-words-here-and-there-and-on', 'quoted words here and there and'),
('d', 7, 'pos-07', 'Slide 7'), ('d', 8, 'a-very-long-title-that-goes-on-and-on-be', 'a very long title that goes on and on beyond'), ('e', 3, 's3', '!!!')) AS v(deck, n, key, label)""",
    "banners": "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text ELSE '> **Live as ' || doc_id || '**' || chr(10) || chr(10) || text END) AS sha, true AS settled FROM documents WHERE text IS NOT NULL",
}
ORACLES["revision_history"] = ORACLES["revision_detection"]
ORACLES["locus_ranges"] = """WITH v AS (SELECT DISTINCT l_suppkey AS chapter, l_orderkey AS verse FROM lineitem)
SELECT a.chapter, a.verse, string_agg('o' || b.verse, ' ' ORDER BY b.verse) AS text, count(*) AS verses FROM v a JOIN v b ON b.chapter = a.chapter AND b.verse BETWEEN a.verse - 400 AND a.verse + 400 WHERE a.verse % 3 = 0 GROUP BY ALL"""
ORACLES["archive_walk"] = "SELECT (o_orderkey // 500)::INTEGER AS page, o_orderkey AS id, o_orderpriority AS slug FROM orders WHERE NOT ((o_orderkey // 500) % 3 = 1 AND o_orderkey % 500 > 100)"
