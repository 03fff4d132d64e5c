import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import alignment, markdown, quotes, reconcile, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "function,given,want",
    [
        (norm.flat_quotes, "‘a’ “b”", "'a' \"b\""),
        (norm.smart_quotes, "\"Don't\" (\"x\")", "“Don’t” (“x”)"),
        (norm.source_text, "Café — l’été ‘quoted’ x-1", "cafe l'ete quoted x 1"),
        (norm.verse_text, "He [is] naïve's", "he is nai ve's"),
        (norm.reader_text, "a<b>b</b>[[FN1]]<figcaption>c</figcaption> &amp;lt; d", "ab &lt; d"),
        (norm.plain_markdown, "# T\n- *a* [b](u) ![i](p)[^1]\n[^1]: note", "T a b"),
        (norm.ingested, "an exam-\nple , here", "an example, here"),
        (norm.without_numbers, "a 12 b 12345", "a b 12345"),
        (norm.slug, "The Cat’s  Hat!", "the-cats-hat"),
        (norm.canonical_href, "https://x.org/a/", "https://x.org/a"),
        (norm.canonical_image, "https://cdn.net/f/https%3A%2F%2Fx.org%2Fi.png", "https://x.org/i.png"),
        (norm.masked, "Page12", "page#"),
        (norm.body_of, "---\na: 1\n---\nbody", "body"),
        (norm.header_text, "a—b – c…", "a--b - c..."),
        (norm.roman, "MCMXIV", 1914),
        (norm.roman, "word", None),
    ],
)
def test_normal_forms(spark, function, given, want):
    assert one(spark, given, function) == want


def test_normal_forms_are_idempotent(spark):
    for f in (norm.flat_quotes, norm.source_text, norm.header_text, norm.slug, norm.plain_markdown):
        for s in ("A ‘b’ — c", "x  y\n", "é’s"):
            once = one(spark, s, f)
            assert one(spark, once, f) == once


def test_three_way(spark):
    rows = lambda s: spark.createDataFrame([(i, h) for i, h in enumerate(s.split()) if h != "-"], "idx int, h string")
    got = reconcile.three_way(rows("A B C D E -"), rows("A B2 C D2 E2 -"), rows("A B C2 D2 E3 X"), ["idx"]).orderBy("idx").collect()
    assert [r.state for r in got] == ["unchanged", "push", "pull", "converged", "conflict", "unknown"]
    assert [r.structure for r in got] == [None] * 5 + ["added_live"]


def test_align_insert(spark):
    docs = spark.createDataFrame([(1, ["A", "B", "C"], ["A", "B", "X", "C"]), (2, ["A"], ["A"])], "k long, base array<string>, side array<string>")
    got = sorted(((r.k, r.base_idx, r.side_idx, r.op) for r in alignment.align(docs, "k").collect()), key=str)
    assert got == sorted([(1, 0, 0, "equal"), (1, 1, 1, "equal"), (1, None, 2, "added"), (1, 2, 3, "equal"), (2, 0, 0, "equal")], key=str)


def verdict(span, stream):
    """The verdict by its definition: all runs of a fragment's words, all gaps."""
    parts = [" ".join(p.split()) for p in span.split("…") if p.split()]
    at, lost = 0, None
    for part in parts:
        if (found := stream.find(part, at)) < 0:
            lost = part
            break
        at = found + len(part)
    if lost is None:
        return ("MATCH", sum(len(p.split()) for p in parts), 1.0) if parts else None
    words, bare = lost.split(), lost.replace(" ", "")
    junk = lambda t: len(t.split()) >= 12 and sum(len(w) <= 2 or not re.fullmatch("[a-z']+", w) for w in t.split()) > 0.35 * len(t.split())
    plain = re.sub(r"\s+", " ", re.sub(r"(?<= )\d{1,4}(?= )", " ", stream))
    if lost not in stream and (bare in stream.replace(" ", "") or lost in plain):
        return "MATCH", len(words), 1.0
    runs = [(j - i, -i) for i in range(len(words)) for j in range(i + 4, len(words) + 1) if " ".join(words[i:j]) in stream]
    if not runs:
        return None
    run, start = max(runs)
    if lost in stream:
        return "OUT OF ORDER", run, 1.0
    at = stream.index(" ".join(words[-start : run - start]))
    window, gaps, to = f" {stream[max(0, at - 300) : at + len(lost) + 700]} ", [], 0
    for w in words:
        found = window.find(f" {w} ", to)
        if found < 0:
            gaps = []
            break
        gaps += [window[to:found].strip()] if to and window[to:found].strip() else []
        to = found + len(w) + 1
    if gaps and sum(map(len, gaps)) <= 400:
        return "MATCH" if all(junk(g) or len(g.split()) <= 2 for g in gaps) else "UNMARKED ELISION", run, 1.0
    near = stream[max(0, at - 300) : at + 3 * len(lost) + 300]
    share = len({w for w in words if f" {w} " in f" {near} "}) / len(words)
    return (("SOURCE ILLEGIBLE HERE" if junk(near) else "DRIFT"), run, share) if share >= 0.6 else None


def best_verdicts(spans, streams):
    """Each span's best by status, score and run; the source by its number."""
    rank = ("MATCH", "UNMARKED ELISION", "OUT OF ORDER", "DRIFT", "SOURCE ILLEGIBLE HERE").index
    out = {}
    for i, span in enumerate(spans):
        found = [(rank(v[0]), -v[2], -v[1], k, v[0]) for k, s in enumerate(streams) if s is not None and (v := verdict(span or "", s))]
        out[i] = (min(found)[4], min(found)[3], -min(found)[2]) if found else ("NO OVERLAP", None, None)
    return out


def found_verdicts(spark, spans, streams):
    rows = quotes.quote_verdicts(spark.createDataFrame(list(enumerate(spans)), "span_id int, span string"), spark.createDataFrame(list(enumerate(streams)), "id int, stream string"), "id").collect()
    return {r.span_id: (r.status, r.source, r.run) for r in rows}


def test_quotation_verdicts(spark):
    stream = "in the beginning was the word and the word was with god and the word was god the same was in the beginning"
    said = "awake from your slumber before it is too late for the sleeper"
    salad = " ".join(f"x{i} q" for i in range(10))
    cases = [  # span, stream, status
        ("the word was with god", stream, "MATCH"), ("in the beginning was a word that nobody wrote down", stream, "NO OVERLAP"), ("in the beginning was the word and some word was", stream, "DRIFT"),
        ("in the beginning was the word was god the same", stream, "UNMARKED ELISION"), ("", stream, "NO OVERLAP"), (None, stream, "NO OVERLAP"),
        ("awake from your slumber before that is too late for all", f"one two {said} three", "DRIFT"), ("awake from your … too late for the", said, "MATCH"), ("too late for the … awake from your slumber", said, "OUT OF ORDER"),
        ("awake from your slumber before it", "awake from your 123 slumber before it", "MATCH"), ("awake from your slumber before it", "awa ke from yo ur slumber before it", "MATCH"),
        (said, said.replace("it is", f"it {salad} is"), "MATCH"), (said.replace("sleeper", "dreamer"), f"{salad} {said} {salad}", "SOURCE ILLEGIBLE HERE"), (said, said.replace("it is", f"it {'word ' * 90}is"), "NO OVERLAP"),
    ]
    for span, held, status in cases:
        assert best_verdicts([span], [held])[0][0] == status, span
    # The same with all streams at once, which share words and copies of each other.
    spans, streams = [c[0] for c in cases], sorted({c[1] for c in cases}) + [None, ""]
    assert found_verdicts(spark, spans, streams) == best_verdicts(spans, streams)


def test_candidates_lose_no_pair(spark):
    streams = ["a a a a a a", "in the beginning was the word", "inthebeg inning wast he wo rd", "he said it 12 was 7 so 9 and 3 then 44 he 5 went home", "art of warfare"]
    spans = ["a a a a a", "word", "the word", "in the beginning was the word", "he said it was so and then he went home", "rt of war", "xart of war then", "none of it", "a", "was the … in the beginning"]
    got = found_verdicts(spark, spans, streams)
    assert got == best_verdicts(spans, streams) and {i for i, r in got.items() if r[0] == "MATCH"} >= {0, 1, 2, 3, 4, 5, 8}


def test_verdicts_on_random_texts(spark):
    """Few words, so that runs tie, overlap and end within words."""
    r = random.Random(3)
    words = ["a", "an", "and", "sand", "the", "then", "he", "12", "long", "longer"]
    streams = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(25)]
    spans = [" ".join(r.choice(words + ["…"] * 1) for _ in range(r.randint(1, 14))) for _ in range(60)]
    assert found_verdicts(spark, spans, streams) == best_verdicts(spans, streams)


def test_footnotes_slides_blocks(spark):
    body = "# T\n\nfirst[^b] and[^a]\n\n> q1\n\n> q2\n\n[^a]: one\n\n[^c]: two\n\n[^a]: again"
    docs = spark.createDataFrame([(1, body)], "id long, text string")
    blocks = markdown.parsed(docs, "id")
    assert sorted((r.label, r.issue) for r in markdown.note_issues(blocks, "id").collect()) == [("b", "undefined"), ("c", "unreferenced")]
    assert [(r.label, r.number, r.text) for r in markdown.ordered_notes(blocks, "id").collect()] == [("a", 1, "again")]
    merged = text.merged_runs(text.blocks(docs, "id"), "id", "idx", "kind", "src", only="blockquote").where("kind = 'blockquote'").collect()
    assert [(r.n, r.src) for r in merged] == [(2, "> q1\n> q2")]
    deck = "intro\n## One\nsaid\n- on\n<!-- slide: two -->\n<!-- design: big -->\nmore"
    got = text.slides(spark.createDataFrame([(1, deck)], "id long, text string"), "id").orderBy("slide_no").collect()
    assert [(r.kind, r.title, r.on, r.notes, r.design) for r in got] == [("section", "One", ["- on"], ["said"], []), ("slide", "two", [], ["more"], ["big"])]


def test_moments(spark):
    said = ["2024-05-01 10:30 +02:00", "2024-05-01 UTC", "2024-05-01", "2024-05-01 Nowhere/Land", "2024-13-01 UTC", None, "'2024-05-01 Z' # note", "2024-05-01 10:30 America/New_York", '"2024-05-01T04:59:59 -0400"', "2024-05-01 25:00 Z", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, raw string")
    want = ["open", "open", "malformed", "malformed", "malformed", "none", "open", "embargoed", "open", "malformed", "none"]
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            now = F.to_timestamp(F.lit("2024-05-01 09:00:00 Z"), "yyyy-MM-dd HH:mm:ss VV")
            assert [r.s for r in df.select("i", reconcile.embargo(F.col("raw"), now).alias("s")).orderBy("i").collect()] == want, zone
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    minutes = spark.createDataFrame([(185,), (-2940,), (4,)], "m int").select(reconcile.human_delta(F.col("m")).alias("t")).collect()
    assert [r.t for r in minutes] == ["in 3h 5m", "2d 1h ago", "in 4m"]


def test_ranges_pointers_and_licences(spark):
    verses = spark.createDataFrame([("gen", 1, i, f"v{i}") for i in range(1, 6)], "section string, chapter int, verse int, text string")
    loci = spark.createDataFrame([("gen 1:2-4", "gen", 1, 2, 4)], "locus string, section string, chapter int, lo int, hi int")
    assert [tuple(r) for r in reconcile.in_range(loci, verses, ["section", "chapter"]).collect()] == [("gen 1:2-4", "v2 v3 v4", 3)]
    pairs = spark.createDataFrame([("a", "b", None), ("b", None, "a"), ("c", "b", None)], "slug string, target string, back string")
    assert [r.slug for r in reconcile.one_sided(pairs, "slug", "target", "back").collect()] == ["c"]
    cells = ["✅ Public domain. ⚠️ OCR.", "⚠️ ours, then ✅", "❌ **Not redistributable.**", "book, no sharing", None, "", "quite ✅"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", reconcile.licence(F.col("c")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == [False, True, True, True, True, True, False]


def test_nothing_checked_is_not_a_pass(spark):
    findings = spark.createDataFrame([("a",)], "rule string")
    checked = spark.createDataFrame([("a", 3), ("b", 2), ("c", 0)], "rule string, n_checked long")
    assert {r.rule: r.status for r in text.findings_summary(findings, checked).collect()} == {"a": "fail", "b": "pass", "c": "not_checked"}


def test_entry_without_the_training_data_operators(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0
