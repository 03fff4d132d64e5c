"""Registries, outlets, schedules, shelves and baselines: joins, ordered decisions and aggregates over their rows.

Null keys meet nothing. Decisions are ordered: the first that applies counts. `now` is always a parameter."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import ranking, reconcile, text

#: Policies of an outlet when a piece waits for its moment; anything else waits.
IMMEDIATE, AT_MOMENT = "immediate", "at_moment"
#: Hours after which a lease whose holder is gone looks abandoned.
ABANDONED_AFTER = 4
EMPTY = "map<string,string>"


def without_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def used_by(uses: DataFrame, keys: list[str], slug: str) -> DataFrame:
    """AG2: the slugs that use each key, sorted, each once."""
    return uses.groupBy(*keys).agg(F.array_sort(F.collect_set(slug)).alias("used_by"))


def per_group(rows: DataFrame, group: str) -> DataFrame:
    """AG3: rows of each group; a null group is counted as such."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("pieces"))


def tallies(rows: DataFrame, key: str, states: list[str], state: str = "state") -> DataFrame:
    """AG4, AG5: how many rows of each key are in each of the states, a column for each."""
    return rows.groupBy(key).agg(*(F.count_if(F.col(state) == s).alias(s) for s in states))


def matching_revisions(revisions: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """FZ11, AG11: of revisions (key, rev, age: 0 is the newest, rows, marks: arrays of digests) and live copies (key, rows, marks) the
    revision that the copy still matches: rows equal at their place count one each, 10,000 more if all do and none is left over,
    and marks break ties; of equal scores the newest wins. A copy without marks is compared by its rows alone."""
    met = revisions.join(live.select(key, F.col("rows").alias("l_rows"), F.col("marks").alias("l_marks")), key)
    equal = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda t: t))
    same = equal(F.col("rows"), F.col("l_rows"))
    exact = (F.size("rows") == F.size("l_rows")) & (same == F.size("rows"))
    bonus = F.when(F.col("l_marks").isNotNull() & (F.size("marks") > 0), equal(F.col("marks"), F.col("l_marks")) / F.size("marks")).otherwise(0.0)
    met = met.withColumns({"matched": same, "score": same + F.when(exact, 10000).otherwise(0) + bonus})
    return met.groupBy(key).agg(F.max_by(F.struct("rev", "matched", "score"), F.struct("score", -F.col("age"))).alias("x")).select(key, "x.*")


def upper_median(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """AG12: least, greatest and upper median of a key's values; the median is one of them, never a mean. Positions come from a
    rank over (value, count), so that equal values are one row."""
    counts = rows.select(key, value.alias("v")).where("v IS NOT NULL").groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    counts = counts.withColumns({"through": F.sum("n").over(w.orderBy("v")), "total": F.sum("n").over(w)})
    return counts.groupBy(key).agg(F.min("v").alias("least"), F.min(F.when(F.col("through") > F.floor(F.col("total") / 2), F.col("v"))).alias("median"), F.max("v").alias("greatest"))


def last_verses(loci: DataFrame, verses: DataFrame, keys: list[str]) -> DataFrame:
    """AG13: the last verse that an index holds for each locus' section and chapter; 0 if it holds none."""
    last = verses.groupBy(*keys).agg(F.max("verse").alias("last"))
    return loci.join(last, keys, "left").withColumn("last", F.coalesce("last", F.lit(0)))


def unbacked_megabytes(files: DataFrame, backed: DataFrame, group: str) -> DataFrame:
    """AG14: files (file, bytes) that no backup has, and their megabytes, by group."""
    return files.join(backed.select("file").distinct(), "file", "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("bytes") / 1048576, 3).alias("mb"))


def newest_first(entries: DataFrame, published: str, order: str) -> DataFrame:
    """ST1: places of an index's entries, the latest published first; ties keep their order, entries without a date come last."""
    day = F.unix_micros(F.col(published).cast("timestamp"))
    return ranking.placed(entries, [day.isNull(), -day, F.col(order)])


def by_moment(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """ST6, TM3: (key, raw, at) of a schedule in the order of the instants, with their place; what is malformed comes last. Moments are sorted
    as instants, not as they are written, so zones may be mixed."""
    out = rows.select(key, raw, reconcile.moment(F.col(raw)).alias("at"))
    return ranking.placed(out, [F.col("at").isNull(), F.col("at"), F.col(key)])


def ignored(restricted: DataFrame, ignored_: DataFrame, files: DataFrame) -> DataFrame:
    """SO7: files that are restricted or already ignored."""
    return files.join(restricted.select("file").union(ignored_.select("file")).distinct(), "file", "left_semi")


def outlet_policy(on_schedule: Column) -> Column:
    """TM5: only the word itself makes an outlet immediate; anything else, null included, waits."""
    return F.when(F.coalesce(F.lower(F.trim(on_schedule)) == IMMEDIATE, F.lit(False)), IMMEDIATE).otherwise(AT_MOMENT)


def published_on(per_outlet: Column, published_at: Column, outlet: Column) -> Column:
    """TM6: a piece's date on an outlet: the outlet's own, else the piece's."""
    own = F.try_element_at(F.coalesce(per_outlet, F.create_map().cast(EMPTY)), outlet)
    return F.coalesce(F.when(own != "", own), F.when(published_at != "", published_at))


def canonical_debt(pieces: DataFrame, outlets: DataFrame, key: str) -> DataFrame:
    """TM5: (key, outlet): outlets that a piece declares, that publish immediately, and on which it is not live yet."""
    declared = pieces.select("*", F.explode("outlets").alias("outlet"))
    immediate = outlets.where(outlet_policy(F.col("on_schedule")) == IMMEDIATE).select(F.col("name").alias("outlet"))
    return declared.join(immediate, "outlet").where(published_on(F.col("published"), F.col("published_at"), F.col("outlet")).isNull()).select(key, "outlet")


def schedule_states(pieces: DataFrame, outlets: DataFrame, records: DataFrame, key: str, now: Column) -> DataFrame:
    """TM7: (key, outlet, state) for each declared outlet: `scheduled` if the moment is ahead and a record (key, outlet) tells that
    the outlet knows, `unscheduled` if there is none, null if the outlet does not wait or the moment is past or missing."""
    rows = pieces.select(key, "publish_at", F.explode("outlets").alias("outlet")).join(outlets.select(F.col("name").alias("outlet"), "on_schedule"), "outlet")
    rows = rows.join(records.select(key, "outlet", F.lit(True).alias("told")).distinct(), [key, "outlet"], "left")
    waits = (outlet_policy(F.col("on_schedule")) == AT_MOMENT) & F.coalesce(reconcile.moment(F.col("publish_at")) > now, F.lit(False))
    return rows.select(key, "outlet", F.when(waits, F.when(F.coalesce("told", F.lit(False)), "scheduled").otherwise("unscheduled")).alias("state"))


def schedule_guards(requests: DataFrame, pieces: DataFrame, outlets: DataFrame, key: str) -> DataFrame:
    """XT16: (key, outlet, verdict) of requests (key, outlet, approved) to record a schedule: no moment, no approval, or an
    immediate outlet of the piece that is not live yet while this one waits; else `record`."""
    debt = canonical_debt(pieces, outlets, key).groupBy(key).agg(F.count(F.lit(1)).alias("debt"))
    rows = requests.join(pieces.select(key, "publish_at"), key, "left").join(debt, key, "left").join(outlets.select(F.col("name").alias("outlet"), "on_schedule"), "outlet", "left")
    blank = F.trim(F.coalesce("approved", F.lit(""))) == ""
    owed = (outlet_policy(F.col("on_schedule")) != IMMEDIATE) & F.col("debt").isNotNull()
    verdict = F.when(reconcile.moment(F.col("publish_at")).isNull(), "no moment").when(blank, "no approval").when(owed, "canonical first").otherwise("record")
    return rows.select(key, "outlet", verdict.alias("verdict"))


def lease_states(leases: DataFrame, now: Column, hours: int = ABANDONED_AFTER) -> DataFrame:
    """TM9: (id, age in minutes, abandoned): a lease whose holder does not live and that is older than so many hours."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("since")) / 60)
    return leases.select("id", age.alias("age"), (~F.coalesce("live", F.lit(False)) & (age > 60 * hours)).alias("abandoned"))


def declared_outlets(pieces: DataFrame, outlets: DataFrame, key: str) -> DataFrame:
    """JN3: (key, outlet, known) for each outlet that a piece declares, each once."""
    names = outlets.select(F.col("name").alias("outlet"), F.lit(True).alias("known")).distinct()
    return pieces.select(key, F.explode(F.array_distinct("outlets")).alias("outlet")).join(F.broadcast(names), "outlet", "left").select(key, "outlet", F.coalesce("known", F.lit(False)).alias("known"))


def reader_urls(manifests: DataFrame, outlets: DataFrame, key: str) -> DataFrame:
    """PJ36: (key, outlet, url) by each outlet's own manifest key; manifests: (key, fields: map). The registry of outlets goes to every
    task: a field is on most pieces, so that by field a few tasks would sort all of them."""
    rows = manifests.select(key, F.explode("fields").alias("field", "url")).where("url <> ''")
    return rows.join(F.broadcast(outlets.select(F.col("name").alias("outlet"), F.col("manifest_url_key").alias("field"), "ord")), "field").select(key, "outlet", "ord", without_slash(F.col("url")).alias("url"))


def live_urls(manifests: DataFrame, outlets: DataFrame, key: str) -> DataFrame:
    """PJ36: a piece's one address: its canonical if that is one of its addresses, else that of the first outlet in order."""
    own = reader_urls(manifests, outlets, key).join(manifests.select(key, without_slash(F.try_element_at("fields", F.lit("canonical"))).alias("canonical")), key)
    first = F.min_by("url", F.struct((~F.coalesce(F.col("url") == F.col("canonical"), F.lit(False))).alias("other"), "ord"))
    return own.groupBy(key).agg(first.alias("url"))


def derived_url(recorded: Column, derive: Column, base: Column, site_slug: Column, sibling: Column, name: Column, slash: Column) -> Column:
    """PJ37: a piece's address on an outlet: the recorded one; none if the outlet's cannot be derived or it has no base; else the
    base and the slug stated for the site, that of its address elsewhere, or its folder's name."""
    last = lambda u: F.element_at(F.split(without_slash(u), "/"), -1)
    given = lambda c: F.when(c != "", c)
    slug = F.coalesce(last(given(site_slug)), last(given(sibling)), name)
    made = F.when(base != "", F.concat(without_slash(base), F.lit("/"), slug, F.when(F.coalesce(slash, F.lit(False)), "/").otherwise("")))
    return F.when(recorded != "", recorded).when(~F.coalesce(derive, F.lit(True)), F.lit(None).cast("string")).otherwise(made)


def renames(pieces: DataFrame) -> DataFrame:
    """PJ38: (old, slug) of pieces (folder, slug, former): every other address that a piece answered to, its folder's included."""
    every = F.array_distinct(F.concat(F.transform(F.coalesce("former", F.array().cast("array<string>")), lambda f: F.trim(f)), F.array("folder")))
    return pieces.select("slug", F.explode(every).alias("old")).where("old <> '' AND old <> slug").select("old", "slug")


def notes_by_source(notes: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """JN10: (key, source, score): the sources whose aliases (source, alias, weight) a note (key, note) holds as substrings of its
    normal form, with the greatest weight. Aliases meet notes by the words inside them, short ones by a scan; their places are not made."""
    streams = notes.select(key, norm.source_text(F.col("note"), ascii_only=True).alias("stream"))
    names = aliases.select(F.monotonically_increasing_id().alias("__a"), "source", "alias", "weight")
    hits = text.held_phrases(streams, names.select("__a", F.col("alias").alias("phrase")).distinct(), key, "__a")
    return hits.join(names, "__a").groupBy(key, "source").agg(F.max("weight").alias("score"))


def notes_by_post(notes: DataFrame, posts: DataFrame, key: str) -> DataFrame:
    """JN12: (key, slug): posts (slug) whose address a note's text holds as a whole."""
    found = notes.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"/p/([\w-]+)"), F.lit(1)))).alias("slug"))
    return found.join(posts.select("slug").distinct(), "slug").select(key, "slug")


def same_images(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """JN13: (file, url) of images that are alike: equal in size, then in digest."""
    return ours.select("file", "size", "md5").join(theirs.select("url", "size", "md5"), ["size", "md5"]).select("file", "url")


def unlisted(pages: DataFrame, indexes: DataFrame) -> DataFrame:
    """JN21: (outlet, slug) of live pages (outlet, url) that the outlet's index page (outlet, html) links nowhere."""
    hrefs = indexes.select("outlet", F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)), " ").alias("hrefs"))
    slug = F.element_at(F.split(without_slash(F.substring_index("url", "?", 1)), "/"), -1)
    rows = pages.select("outlet", slug.alias("slug")).join(hrefs, "outlet")
    return rows.where((F.col("slug") != "") & ~F.contains("hrefs", F.concat(F.lit("/"), F.col("slug")))).select("outlet", "slug")


def unknown_posts(archive: DataFrame, pieces: DataFrame, outlet: str) -> DataFrame:
    """JN22, SC18: posts of an outlet's archive (id, slug, type, outlet), each id once, pages left out, that no piece (slug, outlet)
    claims."""
    own = archive.where((F.col("outlet") == outlet) & ~F.coalesce(F.col("type") == "page", F.lit(False))).dropDuplicates(["id"])
    return own.join(pieces.where(F.col("outlet") == outlet).select("slug"), "slug", "left_anti").select("id", "slug")


def preview_image(html: Column, url: Column) -> Column:
    """PJ15: the address of a page's preview image, made absolute; null if it names none."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)(?:property|name)\s*=\s*[\"']og:image[\"']") & t.rlike(r"(?i)content\s*=\s*[\"'][^\"']+[\"']"))
    said = F.trim(norm.unescaped(F.regexp_extract(F.get(tags, F.lit(0)), r"(?i)content\s*=\s*[\"']([^\"']+)[\"']", 1), norm.MORE_ENTITIES + norm.ENTITIES))
    site, scheme = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), F.regexp_extract(url, r"^(https?:)", 1)
    folder = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"^(https?://.*/)[^/]*$", 1)
    folder = F.when(F.length(folder) > F.length(site), folder).otherwise(F.concat(site, F.lit("/")))
    return F.when(said.rlike("^https?://"), said).when(said.startswith("//"), F.concat(scheme, said)).when(said.startswith("/"), F.concat(site, said)).when(said != "", F.concat(folder, said))


#: What a page's template adds to its text.
TEMPLATE = (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?is)<a\b[^>]*href=\"#footnote[^\"]*\"[^>]*>.*?</a>", r"(?is)<sup\b.*?</sup>")


def without_template(html: Column) -> Column:
    """PJ16: a page without scripts, styles, note anchors and superscripts."""
    for pattern in TEMPLATE:
        html = F.regexp_replace(html, pattern, " ")
    return html


def lost_images(live: DataFrame, drafts: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """XT1: images of live posts (key, src), each asset once, that neither the draft's text (key, text) names nor a file of its
    manifest (key, file, url) that the draft shows: a recompose would lose them."""
    images = live.select(key, norm.canonical_image(F.col("src")).alias("image")).distinct()
    shown = mapped.join(drafts, key).where(F.contains("text", F.col("file"))).select(key, norm.canonical_image(F.col("url")).alias("image")).distinct()
    rest = images.join(shown, [key, "image"], "left_anti").join(drafts, key, "left")
    return rest.where(~F.coalesce(F.contains("text", F.col("image")), F.lit(False))).select(key, "image")


def lost_embeds(live: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """XT1: embeds of live posts (key, embed) that no manifest records."""
    return live.select(key, "embed").distinct().join(recorded.select(key, "embed"), [key, "embed"], "left_anti")


def seeds(rows: DataFrame, key: str) -> DataFrame:
    """XT2: a baseline for each text of rows (key, part, idx, h, hm): digests in order; marks only where all rows have them."""
    listed = lambda part, c: F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("idx", c)))), lambda x: x[c])
    marked = F.every(F.col("hm").isNotNull())
    out = rows.groupBy(key).agg(listed("body", "h").alias("body"), listed("fns", "h").alias("fns"), listed("body", "hm").alias("bm"), listed("fns", "hm").alias("fm"), marked.alias("m"))
    return out.select(key, "body", "fns", F.when(F.col("m"), F.col("bm")).alias("body_marks"), F.when(F.col("m"), F.col("fm")).alias("fns_marks"))


def seal_verdicts(drafts: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """XT4: whether a draft and its live copy (key, title, subtitle, rows, marks) may be sealed: first marks must agree, if the copy has
    them, then texts, then headers; `sealed text` if the copy has no marks."""
    b = live.select(key, *(F.col(c).alias(f"l_{c}") for c in ("title", "subtitle", "rows", "marks")))
    head = lambda a, c: norm.short_digest(F.coalesce(a, F.lit(""))) != norm.short_digest(F.coalesce(c, F.lit("")))
    verdict = (
        F.when(F.col("l_rows").isNull(), "unreachable").when(F.col("l_marks").isNotNull() & ~F.col("marks").eqNullSafe(F.col("l_marks")), "marks differ").when(~F.col("rows").eqNullSafe(F.col("l_rows")), "texts differ")
        .when(head(F.col("title"), F.col("l_title")) | head(F.col("subtitle"), F.col("l_subtitle")), "headers differ").when(F.col("l_marks").isNull(), "sealed text").otherwise("sealed")
    )
    return drafts.join(b, key, "left").select(key, verdict.alias("verdict"))


def outlet_readiness(pieces: DataFrame, outlets: DataFrame, key: str, main: str | None = None) -> DataFrame:
    """XT11: (key, outlet, state) of declared outlets: `store`, `browser`, or `unknown`; a piece that declares none is refused with
    a null outlet. main: the outlet that is never a store by its address alone."""
    rows = pieces.select(key, F.explode_outer(F.when(F.size("outlets") > 0, F.col("outlets"))).alias("outlet")).join(F.broadcast(outlets.withColumnRenamed("name", "outlet")), "outlet", "left")
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    store = F.coalesce("store", F.lit(False)) | (~F.col("outlet").eqNullSafe(F.lit(main)) & has("reader_base") & ~has("account_handle"))
    return rows.select(key, "outlet", F.when(F.col("outlet").isNull(), "none declared").when(store, "store").when(has("account_handle"), "browser").otherwise("unknown").alias("state"))


def shelf_plan(files: DataFrame, rows: DataFrame, shelf: DataFrame) -> DataFrame:
    """XT12: (file, action) of files on disk (file, sha256) by their manifest rows (file, digest, verdict): the first reason to
    refuse, else `push`, or `present` if the shelf (digest) has the file."""
    met = files.join(rows.select("file", F.col("digest").alias("d"), "verdict", F.lit(True).alias("row")), "file", "left")
    met = met.join(shelf.select(F.col("digest").alias("sha256"), F.lit(True).alias("there")).distinct(), "sha256", "left")
    blank = F.coalesce(F.col("d"), F.lit("")) == ""
    action = (
        F.when(F.col("row").isNull(), "no row").when(F.col("verdict").isNull(), "no verdict").when(blank, "no digest").when(~F.expr("startswith(sha256, d)"), "digest mismatch")
        .when(F.length("d") < 64, "truncated digest").when(F.coalesce("there", F.lit(False)), "present").otherwise("push")
    )
    return met.select("file", action.alias("action"))


def pull_plan(rows: DataFrame, files: DataFrame, shelf: DataFrame) -> DataFrame:
    """XT12: (file, action) of manifest rows (file, digest): `unaddressed` without a whole digest, `held` or `differs` if on disk
    (never overwritten), `pull` if the shelf (digest) has it, else `missing`."""
    met = rows.join(files.select("file", "sha256"), "file", "left").join(shelf.select("digest", F.lit(True).alias("there")).distinct(), "digest", "left")
    action = F.when(F.coalesce(F.length("digest"), F.lit(0)) < 64, "unaddressed").when(F.col("sha256") == F.col("digest"), "held").when(F.col("sha256").isNotNull(), "differs").when(F.coalesce("there", F.lit(False)), "pull").otherwise("missing")
    return met.select("file", action.alias("action"))


def rehashed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """XT13: (file, digest, change): the whole digest where the recorded prefix fits the file's bytes or there is none; a prefix
    that does not fit is left as it is."""
    met = rows.join(files.select("file", "sha256"), "file", "left")
    blank = F.coalesce("digest", F.lit("")) == ""
    change = F.when(F.col("sha256").isNull(), "no file").when(blank, "filled").when(F.col("digest") == F.col("sha256"), "whole").when(F.expr("startswith(sha256, digest)"), "completed").otherwise("mismatch")
    return met.select("file", F.when(change.isin("filled", "completed"), F.col("sha256")).otherwise(F.col("digest")).alias("digest"), change.alias("change"))


def snapshot_faults(index: DataFrame, records: DataFrame, images: DataFrame, held: DataFrame) -> DataFrame:
    """XT14, SK9: (slug, fault): entries whose digest is not that of their record, entries without a record, and images (slug,
    file) that are absent or whose bytes (file, content) are no whole PNG file."""
    met = index.join(records.select("slug", F.col("digest").alias("d"), F.lit(True).alias("there")), "slug", "left")
    wrong = met.where(F.col("there").isNull() | ~F.col("digest").eqNullSafe(F.col("d"))).select("slug", F.when(F.col("there").isNull(), "no record").otherwise("digest differs").alias("fault"))
    seen = images.select("slug", "file").distinct().join(held, "file", "left")
    fault = F.when(F.col("content").isNull(), "image absent").when(~is_png(F.col("content")), "image broken")
    return wrong.union(seen.select("slug", fault.alias("fault")).where("fault IS NOT NULL"))


def is_png(content: Column) -> Column:
    """SK9: bytes that begin with the signature of PNG and end with its last chunk."""
    hexed = F.hex(content)
    return F.coalesce(hexed.startswith("89504E470D0A1A0A") & F.substring(hexed, -16, 8).eqNullSafe(F.lit("49454E44")), F.lit(False))


def talk_records(talks: DataFrame) -> DataFrame:
    """XT15: (slug, plain, digest, problem) of talks (slug, title, published_at, outlets, body, tags): the first thing that is missing, or tags,
    which do not belong there; the digest is of the plain words."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    plain = norm.plain_markdown(F.coalesce("body", F.lit("")))
    problem = F.when(blank("slug"), "no slug").when(blank("title"), "no title").when(blank("published_at"), "no date").when(F.coalesce(F.size("outlets"), F.lit(0)) <= 0, "no outlets").when(blank("body"), "no body").when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, "tags")
    return talks.select("slug", plain.alias("plain"), F.concat(F.lit("sha256:"), F.sha2(plain, 256)).alias("digest"), problem.alias("problem"))


def account_verdicts(answers: DataFrame, outlets: DataFrame, primary: str) -> DataFrame:
    """XT10: (id, verdict) of answers (id, outlet, surface, signed_in, status, handle, own_page) by an ordered table: unknown outlet,
    no way to run there, no account named, wrong surface, no answer of the page, signed out, unclear, other account, ok."""
    met = answers.join(outlets.withColumnRenamed("name", "outlet"), "outlet", "left")
    needs = F.when(F.col("outlet") == primary, "pane").otherwise("chrome")
    plain = lambda c: F.lower(F.regexp_replace(F.trim(c), "^@", ""))
    verdict = (
        F.when(F.col("kind").isNull(), "unknown outlet").when(~F.coalesce(F.col("surface").isin("pane", "chrome"), F.lit(False)), "no surface").when((F.col("outlet") != primary) & F.col("browser").isNull(), "no browser")
        .when(F.coalesce(F.col("account_handle"), F.lit("")) == "", "no account").when(F.col("surface") != needs, "wrong surface").when(F.col("signed_in").isNull() | ~F.coalesce("own_page", F.lit(False)), "no answer")
        .when(~F.col("signed_in"), F.when(F.col("status").isin(401, 403), "signed out").otherwise("unclear")).when(F.coalesce("handle", F.lit("")) == "", "no handle").when(plain(F.col("handle")) != plain(F.col("account_handle")), "other account").otherwise("ok")
    )
    return met.select("id", verdict.alias("verdict"))


def multiset(rows: DataFrame, *columns: str) -> DataFrame:
    """A digest of rows that does not depend on their order: their number, and the sums of two hashes of each. It is one row, summed up
    on every task first."""
    both = (F.xxhash64(*columns), F.xxhash64(F.lit(len(columns)), *columns))
    return rows.groupBy().agg(F.struct(F.count(F.lit(1)), *(F.sum(h.cast("decimal(38,0)")) for h in both)).alias("d"))


def changed_at(entries: DataFrame, old: DataFrame, now: Column) -> DataFrame:
    """SK3: the time an index was generated: `now` if its entries (key, value) differ from the old index's (key, value,
    generated_at), else the old time. One row; repeated entries count as often as they stand."""
    was = multiset(old, "key", "value").withColumnRenamed("d", "was").crossJoin(old.groupBy().agg(F.max("generated_at").alias("at")))
    return multiset(entries, "key", "value").crossJoin(was).select(F.when(F.col("d").eqNullSafe(F.col("was")) & F.col("at").isNotNull(), F.col("at")).otherwise(now).alias("generated_at"))


def front_matter(fields: list[str], body: Column) -> Column:
    """SK4: a Markdown file: the fields that are stated, in a fixed order, between lines of dashes, and the body."""
    stated = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.to_json(F.struct(F.col(c).alias("v"))))) for c in fields]))
    lines = F.transform(stated, lambda x: F.regexp_replace(F.regexp_replace(x, r"^(\w+): \{\"v\":", "$1: "), r"\}$", ""))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise(""), F.lit("---\n\n"), body, F.lit("\n"))


#: Between the ordinals of neighbouring fragments, so that others fit in.
ORDINALS = 10


def fragments(docs: DataFrame, key: str) -> DataFrame:
    """SK8: (key, no, ordinal, slug, nth, chunk): a page's parts, each from its heading `## ` to the next, what stands before the first
    as `preamble`; the nth of a slug that repeats. Joined in order they are the page, byte for byte."""
    parts = F.split("text", r"(?m)(?=^## )")
    head = F.trim(F.regexp_extract("chunk", r"\A## ([^\n]*)", 1))
    plain = F.regexp_extract(head, r"\A([a-z0-9][a-z0-9._-]*)(?=\z|[ *(])", 1)
    made = F.regexp_replace(F.regexp_replace(F.lower(head), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    slug = F.when(~F.col("chunk").startswith("## "), "preamble").when(plain != "", plain).when(made != "", made).otherwise("section")
    rows = docs.select(key, F.posexplode(parts).alias("no", "chunk")).where("chunk <> ''").select(key, "no", slug.alias("slug"), "chunk")
    # Parts are dealt by page, once: what meets or is summed up by page afterwards finds them there.
    rows = rows.repartition(F.col(key)).withColumn("nth", F.row_number().over(Window.partitionBy(key, "slug").orderBy("no")))
    return rows.select(key, "no", (F.col("no") * ORDINALS).alias("ordinal"), "slug", "chunk", "nth")


def merged_fragments(fragments_: DataFrame, page: DataFrame, key: str, base: DataFrame | None = None) -> DataFrame:
    """SK8: what becomes of fragments (key, slug, nth, ordinal, chunk, at) and a page's parts (key, slug, nth, no, chunk, at), which meet by
    page, slug and occurrence, each once on a side: (key, slug, nth, ordinal, action, conflict, chunk). With a base (key, slug, nth, chunk)
    the side that has changed since wins; where both have, or without a base, the newer one does, and `conflict` tells that both had. A part
    without a fragment is added behind the fragments, in the page's order; a fragment without a part is kept, never deleted."""
    keys = [key, "slug", "nth"]
    side = lambda rows, name, place, at: rows.select(*keys, F.lit(name).alias("side"), place.alias("place"), "chunk", at.alias("at"))
    sides = side(fragments_, "a", F.col("ordinal"), F.col("at")).union(side(page, "b", F.col("no"), F.col("at")))
    if base is not None:
        sides = sides.union(side(base, "base", F.lit(None), F.lit(None)))
    # Sides meet as rows of one group, dealt by page alone: nothing moves that lies so already, as what `fragments` makes does.
    apart = F.when(F.col(key).isNull() | F.col("slug").isNull() | F.col("nth").isNull(), F.col("side")).alias("apart")
    of = lambda name: F.max(F.when(F.col("side") == name, F.struct("place", "chunk", "at"))).alias(name)
    met = sides.repartition(F.col(key)).groupBy(*keys, apart).agg(of("a"), of("b"), of("base")).where("a IS NOT NULL OR b IS NOT NULL")
    met = met.select(*keys, F.col("a.place").alias("ordinal"), F.col("b.place").alias("no"), F.col("a.at").alias("a_at"), F.col("b.at").alias("b_at"), *(F.col(f"{x}.chunk").alias(x) for x in ("a", "b", "base")))
    ours, theirs = ~F.col("a").eqNullSafe(F.col("base")), ~F.col("b").eqNullSafe(F.col("base"))
    newer = F.when(F.col("b_at") > F.col("a_at"), "ingest").otherwise("keep")
    settled = F.when(F.col("base").isNull() | (ours & theirs), newer).when(theirs, "ingest").otherwise("keep")
    action = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "orphan").when(F.col("a") == F.col("b"), "same").otherwise(settled)
    rows = met.withColumn("action", action).withColumn("conflict", F.coalesce(F.col("base").isNotNull() & (F.col("a") != F.col("b")) & ours & theirs, F.lit(False)))
    last = F.max("ordinal").over(Window.partitionBy(key))
    added = F.count(F.when(F.col("a").isNull(), 1)).over(Window.partitionBy(key).orderBy(F.col("no").asc_nulls_first(), "slug", "nth"))
    ordinal = F.coalesce("ordinal", (F.floor(F.coalesce(last, F.lit(-1)) / ORDINALS) + added) * ORDINALS)
    chunk = F.when(F.col("action").isin("add", "ingest"), F.col("b")).otherwise(F.col("a"))
    return rows.select(*keys, ordinal.cast("long").alias("ordinal"), "action", "conflict", chunk.alias("chunk"))


def rendered_fragments(merged: DataFrame, key: str, *beside: Column) -> DataFrame:
    """SK8: (key, text): a page of its fragments in order; one without a line's end gets it, so that it can't run into the next heading.
    Other sums over a page's fragments may stand beside its text."""
    line = F.when(F.col("chunk").endswith("\n"), F.col("chunk")).otherwise(F.concat("chunk", F.lit("\n")))
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "slug", "nth", line.alias("chunk"))))
    return merged.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["chunk"]), "").alias("text"), *beside)


#: White space within a paragraph: it crosses lines, but no blank line.
WITHIN = r"(?:(?!\n[ \t]*\n)\s)+"


def _anchor(anchor: Column) -> Column:
    """The pattern of an anchor's words with any white space between them; null if it has none."""
    words = F.filter(F.split(anchor, r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1")), WITHIN))


def settled_findings(texts: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """FZ17: (key, old, old_note, text, note, states) of texts (key, text, and perhaps note: a companion's text) with findings (key, no, anchor,
    replacement), each placed, in order, in the text as edited so far: an anchor, whatever white space it is set with, must occur
    once in text and note together. It is `placed`, `absent`, `ambiguous`, `empty`, or `broken` where it crosses a line in the
    note, whose lines stand. States are (no, state)."""
    note = F.coalesce("note", F.lit("")) if "note" in texts.columns else F.lit("")
    todo = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", F.coalesce(_anchor(F.col("anchor")), F.lit("")).alias("pattern"), F.trim(F.regexp_replace(F.coalesce("replacement", F.lit("")), r"(?U)\s+", " ")).alias("now")))).alias("todo"))
    rows = todo.join(texts.select(key, F.coalesce("text", F.lit("")).alias("text"), note.alias("note")), key, "left")
    start = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("note", F.lit("")).alias("note"), F.array().cast(f"array<struct<no:{dict(findings.dtypes)['no']},state:string>>").alias("states"))

    def step(done: Column, x: Column) -> Column:
        count = lambda t: F.when(x["pattern"] == "", 0).otherwise(F.regexp_count(t, x["pattern"]))
        found = lambda t: F.call_function("regexp_extract", t, x["pattern"], F.lit(0))

        def swapped(t: Column) -> Column:
            at = F.regexp_instr(t, x["pattern"])
            return F.concat(F.substring(t, F.lit(1), at - 1), x["now"], F.substring(t, at + F.length(found(t)), F.length(t)))

        in_text, in_note = count(done["text"]), count(done["note"])
        broken = (in_note == 1) & F.contains(found(done["note"]), F.lit("\n"))
        state = F.when(x["pattern"] == "", "empty").when(in_text + in_note == 0, "absent").when(in_text + in_note > 1, "ambiguous").when(broken, "broken").otherwise("placed")
        text_ = F.when((state == "placed") & (in_text == 1), swapped(done["text"])).otherwise(done["text"])
        note_ = F.when((state == "placed") & (in_note == 1), swapped(done["note"])).otherwise(done["note"])
        return F.struct(text_.alias("text"), note_.alias("note"), F.concat(done["states"], F.array(F.struct(x["no"].alias("no"), state.alias("state")))).alias("states"))

    rows = rows.withColumn("done", F.aggregate("todo", start, step))
    return rows.select(key, F.col("text").alias("old"), F.col("note").alias("old_note"), "done.*")


def placed_findings(texts: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """FZ17: (key, no, state) of findings (key, no, anchor) on texts as they are: an anchor, whatever white space it is set with, must
    occur once: `placed`, `absent`, `ambiguous`, `empty`, or `overlaps` where an earlier finding is placed."""
    todo = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", F.coalesce(_anchor(F.col("anchor")), F.lit("")).alias("pattern")))).alias("todo"))
    rows = todo.join(texts.select(key, F.coalesce("text", F.lit("")).alias("text")), key, "left").withColumn("text", F.coalesce("text", F.lit("")))
    start = F.struct(F.array().cast("array<struct<at:int,stop:int>>").alias("marks"), F.array().cast(f"array<struct<no:{dict(findings.dtypes)['no']},state:string>>").alias("states"))

    def step(done: Column, x: Column) -> Column:
        n = F.when(x["pattern"] == "", 0).otherwise(F.regexp_count("text", x["pattern"]))
        at = F.regexp_instr("text", x["pattern"])
        stop = at + F.length(F.call_function("regexp_extract", F.col("text"), x["pattern"], F.lit(0)))
        clash = F.exists(done["marks"], lambda m: (at < m["stop"]) & (m["at"] < stop))
        state = F.when(x["pattern"] == "", "empty").when(n == 0, "absent").when(n > 1, "ambiguous").when(clash, "overlaps").otherwise("placed")
        marks = F.when(state == "placed", F.concat(done["marks"], F.array(F.struct(at.cast("int").alias("at"), stop.cast("int").alias("stop"))))).otherwise(done["marks"])
        return F.struct(marks.alias("marks"), F.concat(done["states"], F.array(F.struct(x["no"].alias("no"), state.alias("state")))).alias("states"))

    return rows.select(key, F.inline(F.aggregate("todo", start, step, lambda done: done["states"])))


def applied_findings(texts: DataFrame, findings: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """FZ17: (key, text, note) with all of a text's replacements, or as it was if one of its findings is not placed. With a width the
    paragraphs of the text that were changed are wrapped again; the note's lines stand."""
    done = settled_findings(texts, findings, key)
    good = F.coalesce(F.forall("states", lambda s: s["state"] == "placed"), F.lit(True))
    text_ = F.col("text")
    if width is not None:
        blank = r"\n[ \t]*\n"
        parts, old, between = F.split("text", blank), F.split("old", blank), F.regexp_extract_all("old", F.lit(blank), F.lit(0))
        wrapped = F.transform(parts, lambda p, i: F.concat(F.when(p == F.get(old, i), p).otherwise(rewrapped(p, width)), F.coalesce(F.get(between, i), F.lit(""))))
        text_ = F.array_join(wrapped, "")
    done = done.select(key, F.when(good, text_).otherwise(F.col("old")).alias("__text"), F.when(good, F.col("note")).otherwise(F.col("old_note")).alias("__note"), F.lit(True).alias("__met"))
    rows = texts.join(done, key, "left")
    out = rows.select(key, F.when(F.col("__met") & F.col("text").isNotNull(), F.col("__text")).otherwise(F.col("text")).alias("text"), *([F.coalesce("__note", "note").alias("note")] if "note" in texts.columns else []))
    return out


def replaced_outside_urls(text_: Column, word: str, to: str) -> Column:
    """PJ29: (text, n): a whole token replaced everywhere but in addresses, with how often."""
    url, token = r"https?://[^\s)>\]]+", rf"(?<![\w-]){re.escape(word)}(?![\w-])"
    to = to.replace("\\", "\\\\").replace("$", "\\$")
    between, urls = F.split(text_, url), F.regexp_extract_all(text_, F.lit(url), F.lit(0))
    swapped = F.transform(between, lambda s: F.regexp_replace(s, token, to))
    n = F.aggregate(F.transform(between, lambda s: F.regexp_count(s, F.lit(token))), F.lit(0), lambda a, b: a + b)
    joined = F.aggregate(F.zip_with(swapped, urls, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), F.lit(""), lambda a, b: F.concat(a, b))
    return F.struct(joined.alias("text"), n.alias("n"))


def rewrapped(text_: Column, width: int = 80) -> Column:
    """PJ30: a paragraph in lines of at most `width` characters, broken at spaces outside links only; longer words stand alone."""
    held = F.aggregate(F.array_distinct(F.regexp_extract_all(text_, F.lit(r"\[[^\]]*\]\([^)]*\)"), F.lit(0))), norm.collapsed(text_), lambda t, m: F.replace(t, m, F.replace(m, F.lit(" "), F.lit("\x01"))))
    words = F.filter(F.split(held, " "), lambda w: w != "")
    line = F.aggregate(
        words,
        F.struct(F.lit("").alias("done"), F.lit("").alias("line")),
        lambda a, w: F.when(a["line"] == "", F.struct(a["done"].alias("done"), w.alias("line")))
        .when(F.length(a["line"]) + 1 + F.length(w) <= width, F.struct(a["done"].alias("done"), F.concat(a["line"], F.lit(" "), w).alias("line")))
        .otherwise(F.struct(F.concat(a["done"], a["line"], F.lit("\n")).alias("done"), w.alias("line"))),
        lambda a: F.concat(a["done"], a["line"]),
    )
    return F.replace(line, F.lit("\x01"), F.lit(" "))


def changed_keys(before: Column, after: Column) -> Column:
    """SK6: the keys of two maps whose values differ or that one side lacks, sorted: an edit of one key must name that key alone."""
    none = F.create_map().cast(EMPTY)
    a, b = F.coalesce(before, none), F.coalesce(after, none)
    keys = F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b)))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))))


def tag_plans(pieces: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """XT9: (key, labels, unlabelled, problem) of pieces (key, publication, post_id, tags): labels of tags that the place takes and tags that
    it does not, in the vocabulary's order; the first thing that forbids it: no publication, no vocabulary, an unknown tag, no post."""
    used = pieces.select(key, "publication", "post_id", F.posexplode_outer("tags").alias("pos", "tag"))
    met = used.join(vocabulary.select("publication", "tag", "label", "takes", "ord"), ["publication", "tag"], "left")
    has = vocabulary.select("publication", F.lit(True).alias("has")).distinct()
    rows = met.groupBy(key, "publication", "post_id").agg(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("ord", "label", "tag", "takes")))).alias("known"), F.count_if(F.col("tag").isNotNull() & F.col("label").isNull()).alias("unknown"))
    rows = rows.join(has, "publication", "left")
    problem = F.when(F.col("publication").isNull(), "no publication").when(F.col("has").isNull(), "no vocabulary").when(F.col("unknown") > 0, "unknown tag").when(F.coalesce("post_id", F.lit("")) == "", "no post")
    labels = F.transform(F.filter("known", lambda x: x["takes"]), lambda x: x["label"])
    return rows.select(key, F.array_join(labels, ",").alias("labels"), F.array_join(F.transform(F.filter("known", lambda x: ~x["takes"]), lambda x: x["tag"]), ",").alias("unlabelled"), problem.alias("problem"))


def slide_keys(slides: DataFrame, deck: str) -> DataFrame:
    """XT5: (deck, n, key, label) of slides (deck, n, kind, title, on): a handle from the title, the first figure or line, or the
    place, cut to 40 characters; the second of a key is `-2`, and so on."""
    shown = F.filter("on", lambda l: l.rlike(r"!\[[^\]]*\]\([^)]*\)"))
    said = F.get(F.filter("on", lambda l: ~l.rlike(r"!\[[^\]]*\]\([^)]*\)")), F.lit(0))
    figure = F.regexp_extract(F.get(shown, F.lit(0)), r"!\[[^\]]*\]\((?:[^)]*/)?([^)/]*?)(?:\.[^).]*)?\)", 1)
    slug = lambda t: F.coalesce(F.when(norm.slug(t) != "", norm.slug(t)), F.concat(F.lit("s"), F.col("n")))
    named = F.coalesce("title", F.lit("")) != ""
    base = (
        F.when(F.col("kind") == "title", "title").when(F.col("kind") == "section", F.concat(F.lit("sec-"), slug(F.coalesce("title", F.lit(""))))).when(named, slug(F.col("title"))).when(F.size(shown) > 0, F.concat(F.lit("fig-"), figure))
        .when(said.isNotNull(), F.concat(F.lit("line-"), slug(F.regexp_replace(said, r"^[>#\-*\d.\s]+", "")))).otherwise(F.concat(F.lit("pos-"), F.lpad(F.col("n").cast("string"), 2, "0")))
    )
    rows = slides.withColumn("__base", F.regexp_replace(F.substring(base, 1, 40), "-+$", ""))
    nth = F.row_number().over(Window.partitionBy(deck, "__base").orderBy("n"))
    label = F.when(F.col("kind") == "title", "Title").when(named, F.col("title")).when(F.size(shown) > 0, figure).when(said.isNotNull(), F.array_join(F.slice(F.split(F.trim(F.regexp_replace(said, r"^[>#\s]+", "")), r"\s+"), 1, 6), " ")).otherwise(F.concat(F.lit("Slide "), F.col("n")))
    return rows.select(deck, "n", F.concat("__base", F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise("")).alias("key"), label.alias("label"))


def without_banner(draft: Column, banner: Column) -> Column:
    """XT8: a draft's header with one banner line (`> **...**`) at its top, an older one replaced; doing it again changes nothing."""
    bare = F.regexp_replace(draft, r"\A(?:> \*\*[^\n]*\*\*\n+)+", "")
    return F.when(F.coalesce(banner, F.lit("")) != "", F.concat(F.lit("> **"), banner, F.lit("**\n\n"), bare)).otherwise(bare)
