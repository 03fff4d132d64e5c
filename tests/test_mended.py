"""Cases that were once wrong, and the code that replaced what was."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import desk, gates, markdown, places, ranking, reconcile, text

TODO = "id long, no int, anchor string, replacement string"


def applied(spark, body, *todo, note=None, width=None):
    texts = spark.createDataFrame([(1, body, note)], "id long, text string, note string")
    rows = spark.createDataFrame([(1, i, *x) for i, x in enumerate(todo)], TODO)
    row = desk.applied_findings(texts, rows, "id", width).first()
    return row.text, row.note


def test_findings_are_placed_in_the_text_as_edited_so_far(spark):
    assert applied(spark, "one two three", ("one", "two"), ("two", "x")) == ("one two three", "")
    assert applied(spark, "one two three", ("two", "2"), ("2 three", "x $1 \\y")) == ("one x $1 \\y", "")
    assert applied(spark, "one two", ("one\n  two", "1  \n 2")) == ("1 2", "")
    assert applied(spark, "one\n\ntwo", ("one two", "x")) == ("one\n\ntwo", "")
    assert applied(spark, "a.b a+b", ("a.b", "x"), ("", "y")) == ("a.b a+b", "")
    assert applied(spark, "one", ("two", "2"), note="two\nthree") == ("one", "2\nthree")
    assert applied(spark, "one", ("two three", "2"), note="two\nthree") == ("one", "two\nthree")
    assert applied(spark, "one two", ("two", "2"), note="two") == ("one two", "two")
    assert applied(spark, "a b\n\nc d\n\ne f", ("c d", "c " + "d" * 9 + " e"), width=9) == ("a b\n\nc\nddddddddd\ne\n\ne f", "")


def test_places_of_findings(spark):
    texts = spark.createDataFrame([(1, "one two three one"), (2, None)], "id long, text string")
    rows = spark.createDataFrame([(1, 1, "two  three"), (1, 2, "three"), (1, 3, "one"), (1, 4, " "), (1, 5, None), (1, 6, "four"), (2, 1, "x"), (3, 1, "x")], "id long, no int, anchor string")
    got = {(r.id, r.no): r.state for r in desk.placed_findings(texts, rows, "id").collect()}
    assert got == {(1, 1): "placed", (1, 2): "overlaps", (1, 3): "ambiguous", (1, 4): "empty", (1, 5): "empty", (1, 6): "absent", (2, 1): "absent", (3, 1): "absent"}


def test_phrases_are_no_patterns(spark):
    streams = spark.createDataFrame([(1, r"a \E b \Q c $1 \E b"), (2, "ab abab ba " * 40), (3, None), (4, "")], "k long, stream string")
    phrases = spark.createDataFrame([(1, r"\E b"), (2, r"\E b \Q c"), (3, "ab"), (4, "$1"), (5, ""), (6, "abab ba ab"), (7, "b a b")], "p long, phrase string")
    held = {r.k: r.stream or "" for r in streams.collect()}
    want = set()
    for k, s in held.items():
        for p in phrases.collect():
            at = s.find(p.phrase) if p.phrase else -1
            while at >= 0:
                want.add((k, p.p, at, s[max(0, at - 5) : at + len(p.phrase) + 5]))
                at = s.find(p.phrase, at + len(p.phrase))
    assert {(r.k, r.p, r["at"], r.context) for r in text.phrase_hits(streams, phrases, "k", "p", 5).collect()} == want and len(want) > 100
    assert text.phrase_hits(streams, phrases.limit(0), "k", "p").count() == 0


def test_leaks_are_counted_by_words(spark):
    r = random.Random(4)
    words = ["a", "b", "c", "d'e"]
    own, other = ([" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(8)] for _ in range(2))
    runs = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    want = {(i, j, len(runs(a) & runs(b))) for i, a in enumerate(own) for j, b in enumerate(other) if runs(a) & runs(b)}
    frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} int, text string")
    assert {(x.i, x.j, x.shared) for x in text.leaked(frame(own, "i"), frame(other, "j"), "i", "j", 3).collect()} == want


def test_replacements_are_no_patterns(spark):
    row = spark.createDataFrame([("a.b axb a.b-c https://a.b/",)], "t string").select(desk.replaced_outside_urls(F.col("t"), "a.b", r"$1 \x").alias("x")).first().x
    assert (row.text, row.n) == (r"$1 \x axb a.b-c https://a.b/", 1)


def test_status_claims(spark):
    said = spark.createDataFrame([("`alpha` is awaiting publish",), ("`alpha` is awaiting a human publish",), ("`alpha` awaits",)], "t string")
    assert [r[0] for r in said.select(gates.near_in_sentence(F.col("t"), F.lit("alpha"), gates.UNPUBLISHED)).collect()] == [True, True, False]


@pytest.mark.parametrize("raw,utc", [("2024-07-01 12:00 America/Argentina/Buenos_Aires", "2024-07-01 15:00"), ("2024-07-01 12:00 Etc/GMT+5", "2024-07-01 17:00"), ("2024-07-01 12:00 America/Nowhere/Else", None), ("2024-07-01 12:00", None)])
def test_zones(spark, raw, utc):
    at = spark.createDataFrame([(raw,)], "t string").select(F.date_format(reconcile.moment(F.col("t")), "yyyy-MM-dd HH:mm").alias("x")).first().x
    assert at == utc


def test_fragments_of_repeated_headings(spark):
    page = "start\n## a\none\n## b\ntwo\n## a\nthree"
    parts = desk.fragments(spark.createDataFrame([("p", page), ("q", "## a\nother\n")], "k string, text string"), "k")
    assert sorted((r.k, r.ordinal, r.slug, r.nth) for r in parts.collect()) == [("p", 0, "preamble", 1), ("p", 10, "a", 1), ("p", 20, "b", 1), ("p", 30, "a", 2), ("q", 0, "a", 1)]
    at = lambda df, n: df.withColumn("at", F.lit(n))
    chunk = lambda slug, nth, to: F.when((F.col("k") == "p") & (F.col("slug") == slug) & (F.col("nth") == nth), to).otherwise(F.col("chunk"))
    ours = at(parts.withColumn("chunk", chunk("a", 2, "## a\nours\n")), 1)
    theirs = at(parts.withColumn("chunk", chunk("a", 1, "## a\ntheirs\n")), 2)
    merged = desk.merged_fragments(ours, theirs, "k", parts)
    assert {r.k: r.text for r in desk.rendered_fragments(merged, "k").collect()} == {"p": "start\n## a\ntheirs\n## b\ntwo\n## a\nours\n", "q": "## a\nother\n"}
    # Both sides edited the same part: the newer one wins and it is told. Without a base the newer one wins everywhere.
    both = desk.merged_fragments(ours, at(theirs.withColumn("chunk", chunk("a", 2, "## a\nlate\n")), 2), "k", parts).where("conflict").collect()
    assert [(r.slug, r.nth, r.action, r.chunk) for r in both] == [("a", 2, "ingest", "## a\nlate\n")]
    fresh = desk.merged_fragments(ours.where("slug <> 'b'"), theirs.where("nth = 1"), "k").where("k = 'p'").collect()
    assert {(r.slug, r.nth): (r.action, r.ordinal) for r in fresh} == {("preamble", 1): ("same", 0), ("a", 1): ("ingest", 10), ("a", 2): ("orphan", 30), ("b", 1): ("add", 40)}


def test_readers_places(spark):
    """What places says that readers see is what the renderer shows."""
    r = random.Random(6)
    bits = ["word", "two words", "*em*", "**bold**", "[link](https://x.org/a)", "[^n]", "\\*", "\\[", "a & b <c>", "\n", "  ", "* ", "![alt](f.png)", "é", "> ", "- ", "**", "_x_"]
    sources = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(1, 9))).strip() for _ in range(400)]
    sources += ["## Head *em*", "### Deep", "---", "> a *b*\n> c\n\n> d", "- a *b*\n  more\n- c", "![alt](x.png)", ""]
    sources = [s for s in sources if "\n\n" not in s or s.startswith("> ")]
    shown = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, s string").select("i", norm.reader_text(markdown.render_block(F.col("s"))).alias("t")).collect()
    different = [sources[x.i] for x in shown if places.reader_places(sources[x.i]).text != x.t]
    # Marks that run from one item of a list into another are told apart only by the renderer; then an edit is refused.
    assert len(different) < 0.03 * len(sources), different[:5]
    assert places.edited("Some *em* or **old** text[^a] of [a link](https://x.org)", "Some em or old text of a link", "Some em or new text of my link") == "Some *em* or **new** text[^a] of [my link](https://x.org)"
    assert places.edited("a *b* c", "a b d", "x") is None and places.edited(None, "a", "b") is None


def test_places_in_one_order(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, 1, 1, 1, 2, 9, 50])) for i in range(5000)]
    got = ranking.placed(spark.createDataFrame(rows, "i int, v int").repartition(7), [F.col("v").isNull(), F.col("v"), -F.col("i")]).collect()
    want = {x[0]: k for k, x in enumerate(sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, -x[0])), 1)}
    assert {x.i: x.place for x in got} == want
    assert ranking.placed(spark.createDataFrame([], "i int"), [F.col("i")]).count() == 0


def test_verses_of_ranges(spark):
    verses = spark.createDataFrame([("a", 1, v, f"t{v}") for v in range(1, 60)] + [("b", 1, 3, "x")], "section string, chapter int, verse int, text string")
    loci = spark.createDataFrame([(1, "a", 1, 14, 18), (2, "a", 1, 5, 5), (3, "a", 1, 9, 3), (4, "b", 1, 1, 9), (5, "c", 1, 1, 2)], "locus int, section string, chapter int, lo int, hi int")
    got = {r.locus: (r.text, r.verses) for r in reconcile.in_range(loci, verses, ["section", "chapter"]).collect()}
    assert got == {1: ("t14 t15 t16 t17 t18", 5), 2: ("t5", 1), 4: ("x", 1)}


def test_times_of_indexes(spark):
    entries = spark.createDataFrame([("a", "1"), ("b", None), ("b", None)], "key string, value string")
    of = lambda old: desk.changed_at(entries, old.withColumn("generated_at", F.lit("then")), F.lit("now")).first()[0]
    assert of(entries.orderBy(F.desc("key"))) == "then" and of(entries.distinct()) == "now" and of(entries.limit(0)) == "now"
    assert desk.changed_at(entries.limit(0), entries.limit(0).withColumn("generated_at", F.lit("then")), F.lit("now")).first()[0] == "now"
