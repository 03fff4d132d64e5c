"""Comparison of states: drift, three-way classification, inventories, registries, upserts and schedules."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import ranking


def classify(base: Column, draft: Column, live: Column) -> Column:
    """FZ10: what changed since the base; `unknown` if a side is missing, never `unchanged`."""
    return (
        F.when(base.isNull() | draft.isNull() | live.isNull(), "unknown")
        .when((draft == base) & (live == base), "unchanged")
        .when(live == base, "push")
        .when(draft == base, "pull")
        .when(draft == live, "converged")
        .otherwise("conflict")
    )


def three_way(base: DataFrame, draft: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, h) of three states that are aligned by key: a state for each, and structure where a side lacks the row."""
    sides = [df.select(*keys, F.col("h").alias(name)) for name, df in (("base", base), ("draft", draft), ("live", live))]
    out = sides[0].join(sides[1], keys, "full").join(sides[2], keys, "full")
    missing = F.when(F.col("base").isNull() & F.col("draft").isNotNull() & F.col("live").isNull(), "added_draft").when(F.col("base").isNull() & F.col("live").isNotNull() & F.col("draft").isNull(), "added_live")
    missing = missing.when(F.col("base").isNotNull() & F.col("draft").isNull() & F.col("live").isNotNull(), "removed_draft").when(F.col("base").isNotNull() & F.col("live").isNull() & F.col("draft").isNotNull(), "removed_live").when(F.col("base").isNotNull() & F.col("draft").isNull() & F.col("live").isNull(), "gone")
    return out.select(*keys, classify(F.col("base"), F.col("draft"), F.col("live")).alias("state"), missing.alias("structure"))


def three_way_marks(base: DataFrame, draft: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """FZ10: rows (keys, h, hm) of three states with two independent verdicts: `state` on texts, `marks` on their marks, which is
    `unknown` where any side has none, or where texts differ and marks cannot be compared. Rows that a side lacks are left out."""
    sides = [df.select(*keys, F.col("h").alias(name), F.col("hm").alias(f"{name}_m")) for name, df in (("base", base), ("draft", draft), ("live", live))]
    out = sides[0].join(sides[1], keys).join(sides[2], keys)
    marks = classify(F.col("base_m"), F.col("draft_m"), F.col("live_m"))
    return out.select(*keys, classify(F.col("base"), F.col("draft"), F.col("live")).alias("state"), marks.alias("marks"))


def held_states(rows: DataFrame, files: DataFrame) -> DataFrame:
    """JN14: manifest rows (file, digests: array) against files (file, sha256): a file is held if it begins with any of the row's
    digests, so that a row may record a published hash and the held one; `none` if the row records no digest."""
    out = rows.join(files.select("file", "sha256"), "file", "full")
    said = F.filter(F.coalesce("digests", F.array().cast("array<string>")), lambda d: F.coalesce(d, F.lit("")) != "")
    match = F.exists(said, lambda d: F.startswith("sha256", d))
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("digests").isNull(), "unlisted").when(F.size(said) == 0, "none").when(match, "match").otherwise("mismatch")
    return out.select("file", state.alias("state"))


def out_of_range(rows: DataFrame, key: str, delta: str, reach: int = 1, least: int = 3, share: float = 0.6) -> DataFrame:
    """AG7: the rows whose delta is further than `reach` from the mode of their key, of keys that agree on one."""
    agreed = calibration(rows, key, delta, least, share).where("calibrated").select(F.col(key).alias("__k"), "mode")
    return rows.join(agreed, F.col(key) == F.col("__k")).where(F.abs(F.col(delta) - F.col("mode")) > reach).drop("__k")


def drift(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """FZ12: of (key, h, marks) the status of each document; marks are compared only where texts agree."""
    out = ours.select(key, F.col("h").alias("h1"), F.col("marks").alias("m1")).join(theirs.select(key, F.col("h").alias("h2"), F.col("marks").alias("m2")), key, "left")
    status = F.when(F.col("h2").isNull(), "UNREACHABLE").when(F.col("h1") != F.col("h2"), "DRIFT").when(F.coalesce(F.col("m1") != F.col("m2"), F.lit(False)), "DRIFT-MARKS").otherwise("MATCH")
    return out.select(key, status.alias("status"))


def upload_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """SK5, SO5: of (key, md5, size) on both sides what to upload, what to skip, and what is stale. The cheap size is
    compared first."""
    out = local.select("key", F.col("md5").alias("m1"), F.col("size").alias("s1")).join(remote.select("key", F.col("md5").alias("m2"), F.col("size").alias("s2")), "key", "full")
    action = F.when(F.col("s1").isNull(), "stale").when(F.col("s2").isNull() | (F.col("s1") != F.col("s2")) | (F.col("m1") != F.col("m2")), "upload").otherwise("skip")
    return out.select("key", action.alias("action"))


def index_losses(live: DataFrame, bundle: DataFrame, keys: list[str]) -> DataFrame:
    """JN16: live entries that the bundle lacks."""
    return live.select(*keys).join(bundle.select(*keys), keys, "left_anti")


def ownership_conflicts(live: DataFrame, bundle: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """JN16: entries whose owners, both stated, differ."""
    out = live.select(*keys, F.col(owner).alias("live_owner")).join(bundle.select(*keys, F.col(owner).alias("bundle_owner")), keys)
    return out.where(F.col("live_owner") != F.col("bundle_owner"))


def unknown_tags(used: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """JN2: composite keys in use that the vocabulary lacks, with how often."""
    return used.join(vocabulary.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("uses"))


def tag_usage(used: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """AG1: uses of each entry of the vocabulary, zero kept."""
    counts = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("uses"))
    return vocabulary.select(*keys).join(counts, keys, "left").select(*keys, F.coalesce("uses", F.lit(0).cast("long")).alias("uses"))


def required_missing(owners: DataFrame, required: DataFrame, held: DataFrame, owner: str, item: str, exempt: DataFrame | None = None) -> DataFrame:
    """JN4: required items that an owner of a group neither holds nor is exempt from. required: (group, item)."""
    wanted = owners.select(owner, "group").join(required, "group").select(owner, item)
    out = wanted.join(held.select(owner, item).distinct(), [owner, item], "left_anti")
    return out if exempt is None else out.join(exempt.select(owner, item).distinct(), [owner, item], "left_anti")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """JN1: rows whose key is stated but unknown to the parents."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")


def one_sided(rows: DataFrame, key: str, target: str, back: str) -> DataFrame:
    """JN15: rows that point to a target which does not point back."""
    a, b = rows.select(key, target), rows.select(F.col(key).alias("__k"), F.col(back).alias("__b"))
    return a.where(F.col(target).isNotNull()).join(b, (F.col(target) == F.col("__k")) & (F.col(key) == F.col("__b")), "left_anti")


def shelf_audit(rows: DataFrame, files: DataFrame) -> DataFrame:
    """JN14: manifest rows (file, digest prefix, redistribution) against files (file, sha256)."""
    out = rows.join(files.select("file", "sha256"), "file", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("digest").isNull(), "unlisted").when(F.expr("startswith(sha256, digest)"), "held").otherwise("altered")
    return out.select("file", state.alias("state"), licence(F.col("redistribution")).alias("restricted"))


#: The marks of a licence cell and whether they restrict.
VERDICTS = {"✅": False, "⚠️": True, "❌": True}


def licence(cell: Column) -> Column:
    """FL15: whether a file is restricted. The first mark of the cell decides; a cell without one (null, empty) restricts."""
    found = F.filter(F.array(*[F.struct(F.instr(cell, mark).alias("at"), F.lit(said).alias("said")) for mark, said in VERDICTS.items()]), lambda x: x["at"] > 0)
    return F.coalesce(F.array_min(found)["said"], F.lit(True))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], lists: list[str], owner: str | None = None) -> DataFrame:
    """SK2, SO6: new values win, lists are sorted unions with the old ones; `change` tells inserts, updates and kept rows. With an owner
    column, a key that another owner holds is `refused` and stays as it is; a key whose old owner isn't stated may be taken."""
    own = [owner] if owner else []
    a = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in values + lists + own), F.lit(True).alias("__old"))
    b = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in values + lists + own), F.lit(True).alias("__new"))
    out = a.join(b, keys, "full")
    foreign = F.coalesce((F.col(f"old_{owner}") != "") & ~F.col(f"old_{owner}").eqNullSafe(F.col(f"new_{owner}")) & F.col("__new"), F.lit(False)) if owner else F.lit(False)
    out = out.withColumn("__takes", F.col("__new").isNotNull() & ~foreign).withColumn("__foreign", foreign)
    same = F.lit(True)
    for c in values + own:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    empty = F.array().cast("array<string>")
    union = {c: F.array_sort(F.array_union(F.coalesce(f"old_{c}", empty), F.when(F.col("__foreign"), empty).otherwise(F.coalesce(f"new_{c}", empty)))) for c in lists}
    for c in lists:
        same = same & (union[c] == F.coalesce(f"old_{c}", empty))
    change = F.when(F.col("__foreign"), "refused").when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull() | same, "keep").otherwise("update")
    picked = [F.when(F.col("__takes"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in values + own]
    return out.select(*keys, *picked, *(union[c].alias(c) for c in lists), change.alias("change"))


#: A date, a time and a zone (Z, UTC, an offset or a region).
MOMENT = r"^(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2})(:\d{2})?)?\s*(Z|UTC|[+-]\d{2}:?\d{2}|[A-Za-z][A-Za-z0-9_+\-]*(?:/[A-Za-z0-9_+\-]+)+)$"


def moment(raw: Column) -> Column:
    """TM1: an instant from a date, a time (00:00) and a mandatory zone, in quotes or not, before a comment; null if malformed,
    an unknown zone included. The session's own zone plays no part."""
    text = F.trim(F.regexp_replace(F.trim(F.substring_index(raw, "#", 1)), "^[\"']+|[\"']+$", ""))
    day, clock, seconds, zone = (F.regexp_extract(text, MOMENT, i) for i in (1, 2, 3, 4))
    zone = F.when(zone.isin("Z", "UTC"), "+00:00").when(zone.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone)
    written = F.concat(day, F.lit(" "), F.when(clock == "", "00:00").otherwise(clock), F.when(seconds == "", ":00").otherwise(seconds), F.lit(" "), zone)
    return F.when(text.rlike(MOMENT), F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss VV")))


def embargo(raw: Column, now: Column) -> Column:
    """TM2: none, malformed, embargoed or open at `now`, which is a parameter."""
    at = moment(raw)
    return F.when(raw.isNull() | (F.trim(raw) == ""), "none").when(at.isNull(), "malformed").when(now >= at, "open").otherwise("embargoed")


def due(rows: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    """TM3: rows whose moment is reached within so many hours."""
    return rows.where(F.col(at) <= now + F.make_dt_interval(F.lit(0), F.lit(hours)))


def human_delta(minutes: Column) -> Column:
    """TM4: `in 3h 5m`, `2d 1h ago`."""
    m = F.abs(minutes)
    days, hours, rest = F.floor(m / 1440), F.floor(m % 1440 / 60), m % 60
    text = F.when(days > 0, F.concat(days, F.lit("d "), hours, F.lit("h"))).when(hours > 0, F.concat(hours, F.lit("h "), rest, F.lit("m"))).otherwise(F.concat(rest, F.lit("m")))
    return F.when(minutes >= 0, F.concat(F.lit("in "), text)).otherwise(F.concat(text, F.lit(" ago")))


def note_state(skip: Column, posted: Column, drafted: Column) -> Column:
    """TM8: skip before posted before drafted before missing."""
    return F.when(skip, "skip").when(posted, "posted").when(drafted, "drafted").otherwise("missing")


def notes_backlog(notes: DataFrame, today: Column) -> DataFrame:
    """TM8: (slug, state, place, done_today) of notes (slug, published_at, posted_at, drafted, skip): what is missing has a place in the
    backlog, oldest first; done today is what was posted today of a piece of another day."""
    state = note_state(F.coalesce("skip", F.lit(False)), F.col("posted_at").isNotNull(), F.coalesce("drafted", F.lit(False)))
    rows = notes.withColumn("state", state)
    missing = ranking.placed(rows.where("state = 'missing'"), [F.col("published_at").isNull(), F.col("published_at"), F.col("slug")]).select("slug", "place")
    done = (F.col("posted_at") == today) & ~F.col("published_at").eqNullSafe(today)
    return rows.join(missing, "slug", "left").select("slug", "state", "place", F.coalesce(done, F.lit(False)).alias("done_today"))


def gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """FL17, WN5: where a key's numbers do not go up by one: (key, after, next)."""
    following = F.lead(number).over(Window.partitionBy(key).orderBy(number))
    return rows.select(key, F.col(number).alias("after"), following.alias("next")).where("next IS NOT NULL AND next <> after + 1")


def calibration(rows: DataFrame, key: str, delta: str, least: int = 3, share: float = 0.6) -> DataFrame:
    """AG7: the most frequent delta of a key (ties: the least), how many agree within one, and whether that is enough."""
    counts = rows.groupBy(key, delta).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.max_by(delta, F.struct("n", -F.col(delta))).alias("mode"), F.sum("n").alias("seen"))
    near = counts.join(best, key).groupBy(key, "mode", "seen").agg(F.sum(F.when(F.abs(F.col(delta) - F.col("mode")) <= 1, F.col("n")).otherwise(0)).alias("agree"))
    return near.where(F.col("seen") >= least).select(key, "mode", "seen", "agree", (F.col("agree") >= share * F.col("seen")).alias("calibrated"))


#: Verdicts, best first.
RANKS = ("MATCH", "UNMARKED ELISION", "OUT OF ORDER", "DRIFT", "SOURCE ILLEGIBLE HERE", "NOT FOUND", "NO OVERLAP")


def best_source(rows: DataFrame, keys: list[str]) -> DataFrame:
    """FZ5, ST5: of (keys, source, status, score, run) the best: by rank, then score and run, then source."""
    rank = F.array_position(F.array(*[F.lit(x) for x in RANKS]), F.col("status"))
    best = F.min_by(F.struct("source", "status", "score", "run"), F.struct(rank.alias("r"), (-F.col("score")).alias("s"), (-F.col("run")).alias("n"), "source"))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def capped(rows: DataFrame, keys: list[str], order: list, n: int, parts: int = 64) -> DataFrame:
    """AG8, WN9: the first n rows of each key, with the key's total: a report. Each key's rows are ranked in `parts` parts by a
    hash first, so that no task sorts a whole key; totals are summed before they are shuffled."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(parts))
    first = rows.withColumn("__p", part).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order))).where(F.col("__r") <= n)
    best = first.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r", "__p")
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}"))
    return best.alias("b").join(totals.alias("t"), met).select("b.*", "t.total")


#: Verses of the narrowest buckets by which ranges and verses meet: 2 to this power.
NARROW = 4


def verses_in(ranges: DataFrame, verses: DataFrame, keys: list[str]) -> DataFrame:
    """JN8: each range (keys, lo, hi, and more) with the verses (keys, verse, text) in it, as __v and __t. Verses meet ranges by their bucket
    of neighbouring numbers. Buckets are as wide as the range, up to the next power of two, so that a range touches two at most and
    meets few verses that are not its own; a verse is in one bucket of each width that a range has. In a range that is upside down
    there is nothing."""
    at = lambda c: F.expr(f"shiftright({c}, __width)")
    r = ranges.where("hi >= lo").withColumns({"__lo": F.col("lo").cast("long"), "__hi": F.col("hi").cast("long")})
    r = r.withColumn("__width", F.greatest(F.length(F.bin(F.col("__hi") - F.col("__lo"))), F.lit(NARROW)))
    v = verses.select(*keys, F.col("verse").alias("__v"), F.col("text").alias("__t")).crossJoin(F.broadcast(r.select("__width").distinct()))
    v = v.withColumn("__bucket", at("CAST(__v AS BIGINT)"))
    met = r.withColumn("__bucket", F.explode(F.sequence(at("__lo"), at("__hi")))).join(v, [*keys, "__width", "__bucket"])
    return met.where(F.col("__v").between(F.col("lo"), F.col("hi"))).drop("__bucket", "__width", "__lo", "__hi")


def in_range(loci: DataFrame, verses: DataFrame, keys: list[str]) -> DataFrame:
    """JN8: (locus, text, verses): the verses lo..hi of each locus, joined in order."""
    met = verses_in(loci, verses, keys)
    return met.groupBy("locus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__v", "__t"))), lambda x: x["__t"]), " ").alias("text"), F.count(F.lit(1)).alias("verses"))


def page_drift(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """FZ12: the status of each text against its live copy, from (key, header, body, fns, body_marks, fns_marks, body_anchors, fns_anchors,
    captions: arrays of strings). Marks and anchors are compared only if both sides have as many blocks and notes, and there only
    where the texts are equal. What differs alone names its kind; anything else is DRIFT, a missing copy UNREACHABLE."""
    parts = ("header", "body", "fns", "body_marks", "fns_marks", "body_anchors", "fns_anchors", "captions")
    met = ours.select(key, *parts).join(theirs.select(key, *(F.col(p).alias(f"l_{p}") for p in parts), F.lit(True).alias("__there")), key, "left")
    same = lambda p: F.col(p).eqNullSafe(F.col(f"l_{p}"))
    aligned = (F.size("body") == F.size("l_body")) & (F.size("fns") == F.size("l_fns"))

    def unlike(part: str, of: str) -> Column:
        rows = F.arrays_zip(F.col(of).alias("a"), F.col(f"l_{of}").alias("b"), F.col(f"{of}_{part}").alias("x"), F.col(f"l_{of}_{part}").alias("y"))
        return aligned & F.exists(rows, lambda r: (r["a"] == r["b"]) & ~r["x"].eqNullSafe(r["y"]))

    marks, anchors = (unlike(p, "body") | unlike(p, "fns") for p in ("marks", "anchors"))
    rest, captions = same("header") & same("body") & same("fns"), ~same("captions")
    status = (
        F.when(F.col("__there").isNull(), "UNREACHABLE").when(rest & ~marks & ~captions & ~anchors, "MATCH").when(rest & marks & ~captions & ~anchors, "DRIFT-MARKS").when(rest & captions & ~marks & ~anchors, "DRIFT-CAPTION")
        .when(rest & anchors & ~marks & ~captions, "DRIFT-ANCHORS").otherwise("DRIFT")
    )
    return met.select(key, status.alias("status"))
