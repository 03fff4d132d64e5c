"""Findings F8 to F23 of round 3: what grew faster than the input, or moved more than it had to."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import desk, text
from corpusloom.sources import builders


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_streams_meet_a_query_set_in_their_rows(spark, monkeypatch):
    """A stream is read once and never shuffled; on every path the same phrases are held, at the same places."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices("a ab ba abba é zz".split(), k=60))) for k in range(30)] + [(30, None), (31, ""), (32, "a" * 40)]
    streams = spark.createDataFrame(rows, "k long, stream string")
    phrases = spark.createDataFrame([(p, " ".join(rng.choices("a ab ba abba é zz".split(), k=rng.randint(1, 5)))) for p in range(40)] + [(40, "é"), (41, " "), (42, "a" * 15)], "p long, phrase string")
    assert "hashpartitioning" not in plan(text.phrase_hits(streams, phrases, "k", "p"))
    want = set()
    for k, s in rows:
        for p in phrases.collect():
            at = (s or "").find(p.phrase) if p.phrase.strip() else -1
            while at >= 0:
                want.add((k, p.p, at))
                at = s.find(p.phrase, at + len(p.phrase))
    for scanned, probes in ((256, 4096), (0, 4096), (256, 3), (0, 3)):
        monkeypatch.setattr(text, "SCANNED", scanned)
        monkeypatch.setattr(text, "PROBES", probes)
        assert {(r.k, r.p, r["at"]) for r in text.phrase_hits(streams, phrases, "k", "p").collect()} == want
        assert {(r.k, r.p) for r in text.held_phrases(streams, phrases, "k", "p").collect()} == {(k, p) for k, p, _ in want}


def test_short_phrases_in_a_long_stream(spark):
    """F8: 400,000 characters; each run of them was cut from the stream's beginning."""
    streams = spark.createDataFrame([(1, "ab " * 133_000 + "er th")], "k long, stream string")
    phrases = spark.createDataFrame([(1, "ab"), (2, "er th"), (3, "zzzz"), (4, "b a")], "p long, phrase string")
    assert sorted(r.p for r in text.held_phrases(streams, phrases, "k", "p").collect()) == [1, 2, 4]


def test_furniture_moves_hashes_and_is_told_in_rows(spark, monkeypatch):
    """a page's text is not shuffled to lose its furniture; each path finds the same."""
    rng = random.Random(9)
    rows = [(g, k, " ".join(rng.choices("a B c1 c22 d".split(), k=rng.randint(0, 12)))) for k, g in enumerate(["x", "1:x", "y"] * 12)] + [("y", 90, None), ("few", 91, "a B d"), (None, 92, "a B d")]
    pages = spark.createDataFrame(rows, "g string, k long, text string")
    masked = lambda s: ["c#" if w[0] == "c" else w.lower() for w in s.split()]
    runs = lambda s: [" ".join(masked(s)[i : i + 3]) for i in range(len(masked(s)) - 2)]
    want, left = set(), {}
    for g in ("x", "1:x", "y"):
        texts = [t for h, _, t in rows if h == g]
        for run in {r for t in texts for r in runs(t or "")}:
            n = sum(run in runs(t or "") for t in texts)
            if n >= max(2, int(len(texts) * 0.3)):
                want.add((g, run, n, len(texts)))
    for g, k, t in rows:
        gone = {i + j for i, r in enumerate(runs(t or "")) for j in range(3) if any(w[:2] == (g, r) for w in want)}
        left[k] = None if t is None else " ".join(w for i, w in enumerate(t.split()) if i not in gone)
    assert want
    for probes in (4096, 2):
        monkeypatch.setattr(text, "PROBES", probes)
        found = text.furniture(pages, "g", "k", share=0.3)
        assert {tuple(r) for r in found.collect()} == want
        out = text.without_furniture(pages, found, "g", "k")
        assert {r.k: r.text for r in out.collect()} in (left, left | {90: ""})
        assert ("Join" in plan(out)) == (probes == 2)


def test_findings_of_chapters_from_one_gathering(spark):
    """chapters were made anew for each kind of finding; now each text is made once."""
    numerals = ["I", "II", "IV", "III", "VI"]
    body = "\n".join(f"CHAPTER {n}\n" + "word " * (50 if i == 2 else 3 + i) for i, n in enumerate(numerals))
    docs = spark.createDataFrame([("a", body), ("b", "CHAPTER I\nx\nCHAPTER II\n\nCHAPTER III\ny"), ("c", None)], "source string, text string")
    rows = builders.chapters(docs)
    out = builders.chapter_findings(rows, 5, 2)
    far, order, gone = "far longer than the median", "out of order", "missing"
    want = [("a", far, 4), ("a", order, 4), ("a", order, 3), ("a", order, 6), ("a", gone, 5), ("b", gone, 2), ("b", gone, 4), ("b", gone, 5)]
    assert sorted(map(tuple, out.collect())) == sorted([*want[:2], ("a", order, 3), *want[3:]])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_only_what_composition_touches_goes_to_python(spark):
    """all texts went there, ASCII ones too."""
    import unicodedata

    still = [chr(c) for c in (*range(0x300), *range(0x2010, 0x2028))]
    assert all(unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) for c in still)
    seconds = {chr(c): unicodedata.decomposition(chr(c)).split() for c in range(0x110000) if unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))}
    assert not {chr(int(d[1], 16)) for d in seconds.values() if len(d) == 2} & set(still)
    rows = [("é – “plain” ß",), ("é x",), ("plain",), (None,), ("Å",)]
    df = spark.createDataFrame(rows, "t string").select("t", norm.ingested(F.col("t")).alias("n"))
    assert {(r.t, r.n) for r in df.collect()} == {(t, t and unicodedata.normalize("NFC", t)) for (t,) in rows}
    assert "CASE WHEN" in plan(df).split("compose(")[1][:40]


def test_the_registry_of_outlets_goes_to_the_pieces(spark):
    """pieces were sorted by outlet or field, of which there are few, so that few tasks held all of them."""
    outlets = spark.createDataFrame([("site", "site_url", 1, "", "", False), ("feed", "public_url", 2, "b", "", False)], "name string, manifest_url_key string, ord int, reader_base string, account_handle string, store boolean")
    manifests = spark.createDataFrame([("a", {"site_url": "https://x.org/a/", "other": "y"}), ("b", {"public_url": ""})], "slug string, fields map<string,string>")
    pieces = spark.createDataFrame([("a", ["site", "feed", "zz"]), ("b", None)], "slug string, outlets array<string>")
    urls, ready, declared = desk.reader_urls(manifests, outlets, "slug"), desk.outlet_readiness(pieces, outlets, "slug"), desk.declared_outlets(pieces, outlets, "slug")
    assert all("SortMergeJoin" not in plan(df) for df in (urls, ready, declared))
    assert [(r.slug, r.outlet) for r in urls.collect()] == [("a", "site")]
    assert {(r.slug, r.outlet, r.state) for r in ready.collect()} == {("a", "site", "unknown"), ("a", "feed", "store"), ("a", "zz", "unknown"), ("b", None, "none declared")}
    assert {(r.outlet, r.known) for r in declared.collect()} == {("site", True), ("feed", True), ("zz", False)}
