"""Findings F11 to F23 of round 3: what grew faster than the input, or moved more than it had to."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import desk, html, markdown, pronouns, reconcile


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_wide_range_touches_few_buckets(spark):
    """a range was dealt to a bucket for each 16 numbers in it, so that an open one was too long to deal."""
    rng = random.Random(11)
    verses = [("ab"[v % 2], v, f"t{v}") for v in rng.sample(range(-300, 3000), 900)]
    ranges = [(k, rng.choice("abc"), lo := rng.randint(-400, 3000), lo + rng.choice([-1, 0, 1, 15, 16, 17, 63, 64, 800, 10**12])) for k in range(120)]
    got = reconcile.in_range(spark.createDataFrame(ranges, "locus int, section string, lo long, hi long"), spark.createDataFrame(verses, "section string, verse int, text string"), ["section"])
    want = {k: [t for s, v, t in sorted(verses, key=lambda x: x[1]) if s == section and lo <= v <= hi] for k, section, lo, hi in ranges}
    assert {r.locus: (r.text, r.verses) for r in got.collect()} == {k: (" ".join(t), len(t)) for k, t in want.items() if t}


def test_a_draft_is_split_and_dealt_once(spark):
    """readers' views had drafts split for the body, for the notes and for the references, and joined again."""
    text = "head\n---\nOne[^a] \\*and\\* *two*[^b].\n\n> q\n\n[^b]: second\n\n> r[^a]\n\n[^a]: first & last\n\n    more\n\n---\n\n![x](y.png)\n\nThe end[^b] [^none]"
    docs = spark.createDataFrame([(1, text), (2, "head\n---\n![x](y.png)\n\nonly"), (3, None), (4, "")], "k long, text string")
    assert "Join" not in plan(markdown.rendered(docs, "k")) and "Join" not in plan(markdown.article(docs, "k"))
    rows = {(r.k, r.part, r.idx): (r.text, r.divided) for r in markdown.rendered(docs, "k").collect()}
    assert rows == {
        (1, "body", 0): ("One *and* two.", False), (1, "body", 1): ("qr", False), (1, "body", 2): ("The end", False),
        (1, "fns", 0): ("first & last more", False), (1, "fns", 1): ("second", False), (2, "body", 0): ("only", False),
    }
    html = {(r.k, r.part, r.idx): (r.html, r.figure) for r in markdown.article(docs, "k").collect()}
    assert html[1, "body", 0] == ("<p>One[1] *and* <em>two</em>[2].</p>", None) and html[1, "body", 1][0] == "<blockquote><p>q</p><p>r[1]</p></blockquote>"


def test_notes_of_a_text_are_found_once(spark):
    """a text's notes were looked for anew in the whole text for each of its paragraphs."""
    notes = "\n\n".join(f"[^k{i}]: John 3:16\n    and more" for i in range(3))
    docs = spark.createDataFrame([(1, "*I am He* [^k1] and *plain He*\n\n> He hath said [^k0]\n\nGod itself. They are One, it is itself.\n\n" + notes, ["Anna"], [])], "k long, text string, figures array<string>, allow array<string>")
    # The pattern of notes stands below the generator of paragraphs: at a greater depth of the plan.
    tree = plan(pronouns.quotations(pronouns.paragraphs(docs, "k"), "k")).split("\n")
    depth = lambda sign: max(i for i, line in enumerate(tree) if sign in line)
    assert depth(r"^\[\^([^\]\n]+)\]:") > depth("Generate posexplode")
    got = {(r.section, r.para, r.unit, r["at"], r.word, r.evidence) for r in pronouns.sweep(docs, "k").collect()}
    assert {("E", 0, 0, 5, "He", "ref:k1"), ("E", 1, 0, 0, "He", "ref:k0"), ("H", 2, 0, 4, "itself", "subject:God")} <= got and not any(s == "E" and u == 22 for s, _, u, *_ in got)


def test_few_pages_are_held_as_objects(spark):
    """a batch's 10,000 pages were all held as Python objects, blocks and marks, before any became Arrow's."""
    pages = pa.array([f"<p>a <em>b{i}</em></p>" * (i % 3) for i in range(150)] + [None, ""])
    held = []
    whole, html.page_blocks = html.page_blocks, lambda p: held.append(p) or whole(p)
    try:
        got = html._parsed(pages)
    finally:
        html.page_blocks = whole
    assert isinstance(got, pa.Array) and len(held) == 152 and html._parsed(pages.slice(0, 0)).to_pylist() == []
    assert [len(b) for b in got.to_pylist()] == [i % 3 for i in range(150)] + [0, 0]
    assert got[1].as_py() == [{"kind": "p", "text": "a b1", "marks": [{"start": 2, "end": 4, "kind": "em", "text": "b1", "href": ""}], "anchors": []}]
    df = spark.createDataFrame([("<p>a <em>b</em></p>",), (None,)], "page string")
    assert [len(r.b) for r in df.select(html.blocks_of(F.col("page")).alias("b")).collect()] == [1, 0]


def test_parts_of_pages_are_dealt_once(spark):
    """chunks were dealt anew for their headings, for each side of each join, and for the page's order."""
    pages = [(k, "".join(f"## {'abc'[(k + i) % 3]}\n{k} {i}\n" for i in range(k % 5))) for k in range(60)]
    parts = desk.fragments(spark.createDataFrame(pages, "k long, text string").where("k IS NOT NULL"), "k")
    said = F.when(F.col("k") % 4 == 0, F.concat("chunk", F.lit("late\n"))).otherwise(F.col("chunk")).alias("chunk")
    ours, theirs = parts.where("(k + no) % 7 <> 0").withColumn("at", F.lit(1)), parts.where("(k + no) % 3 <> 0").select("k", "slug", "nth", "no", said, F.lit(2).alias("at"))
    merged = desk.merged_fragments(ours, theirs, "k", parts)
    rendered = desk.rendered_fragments(merged, "k")
    got = {r.k: r.text for r in rendered.collect()}
    done = rendered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    assert sum("Exchange hashpartitioning" in x and "ReusedExchange" not in x for x in done) == 1
    want = {}
    for k, _ in pages:
        chunk = lambda i: f"## {'abc'[(k + i) % 3]}\n{k} {i}\n" + "late\n" * (k % 4 == 0 and (k + i) % 3 > 0)  # noqa: B023, E731
        own, new = [i for i in range(k % 5) if (k + i) % 7], [i for i in range(k % 5) if not (k + i) % 7 and (k + i) % 3]
        if own or new:
            want[k] = "".join(map(chunk, own + new))
    assert got == want
    beside = desk.rendered_fragments(merged, "k", F.count_if(F.col("action") == "add").alias("n"))
    assert {r.k: r.n for r in beside.collect()} == {k: sum(not (k + i) % 7 for i in range(k % 5) if (k + i) % 7 or (k + i) % 3) for k in want}


def test_parts_without_a_page_meet_nothing(spark):
    """sides meet in groups, where nulls would be equal."""
    side = lambda rows, place: spark.createDataFrame(rows, f"k long, slug string, nth int, {place} int, chunk string, at int")
    ours, theirs = side([(None, "a", 1, 0, "x", 1), (1, "a", 1, 0, "y", 1)], "ordinal"), side([(None, "a", 1, 0, "x", 1), (1, "a", 1, 0, "z", 2), (2, "a", 1, 3, "w", 1)], "no")
    base = side([(None, "a", 1, 0, "x", 1), (3, "a", 1, 0, "v", 1)], "ordinal")
    got = sorted((r.k or 0, r.action, r.ordinal, r.chunk) for r in desk.merged_fragments(ours, theirs, "k", base).collect())
    assert got == [(0, "add", 10, "x"), (0, "orphan", 0, "x"), (1, "ingest", 0, "z"), (2, "add", 0, "w")]
