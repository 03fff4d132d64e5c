from pyspark.sql import functions as F

from corpusloom.operators import checks, html
from corpusloom.sources import files


def test_marks_come_together_before_they_are_trimmed():
    (kind, text, marks, anchors), = html.page_blocks('<p><strong>There is no </strong><strong><em>toward</em></strong> it<a class="footnote-anchor">1</a>.</p>')
    assert (kind, text) == ("p", "There is no toward it.")
    assert marks == [(0, 18, "strong", "There is no toward", ""), (12, 18, "em", "toward", "")]
    assert anchors == [(21, "1")]


def test_blocks_of_pages():
    page = '<p>a &amp; b</p><blockquote><p>q <i>x</i> y</p></blockquote><figure><p>no</p></figure><script>no</script><ul><li><p>one</p></li></ul><div class="footnote"><p>no</p><div class="footnote-content"><p>note <a href="https://x.org/a/">l</a></p></div></div>'
    assert [(k, t) for k, t, _, _ in html.page_blocks(page)] == [("p", "a & b"), ("blockquote", "q x y"), ("ul", "one"), ("note", "note l")]
    assert html.page_blocks(page)[3][2] == [(5, 6, "link", "l", "https://x.org/a")]
    assert html.page_blocks(None) == html.page_blocks("") == html.page_blocks("<p> </p>") == []
    assert [m[:4] for m in html.page_blocks("<p><em>a</em> plain <em>b</em></p>")[0][2]] == [(0, 1, "em", "a"), (8, 9, "em", "b")]


def test_anchor_tails_and_captions(spark):
    df = spark.createDataFrame([('<p>One<a class="footnote-anchor">1</a> two</p><figure><img><figcaption>A <b>c</b></figcaption></figure><figure></figure>',), (None,)], "h string")
    got = df.select(F.transform(html.blocks_of(F.col("h")), lambda b: html.anchor_tails(b)).alias("t"), html.captions(F.col("h")).alias("c")).collect()
    assert [tuple(x) for x in got[0].t[0]] == [("1", "One")] and got[0].c == ["A c", ""]
    assert got[1].t == [] and got[1].c is None


def test_garbled(spark):
    df = spark.createDataFrame([("a1 b2 c3 d4 e5 word word word word word word word",), ("word " * 12,), ("x y",), (None,)], "s string")
    assert [r.g for r in df.select(checks.garbled(F.col("s")).alias("g")).collect()] == [True, False, False, False]


def test_captions_findings(spark):
    images = spark.createDataFrame([(1, "u"), (1, "b.png"), (1, "c.png")], "k int, src string")
    urls = spark.createDataFrame([(1, "u", "a.png")], "k int, url string, file string")
    captions = spark.createDataFrame([(1, "a.png", "A"), (1, "b.png", " "), (1, "z.png", "Z")], "k int, file string, caption string")
    got = sorted((r.file, r.finding) for r in checks.caption_findings(images, captions, urls, "k").collect())
    assert got == [("b.png", "missing"), ("c.png", "missing"), ("z.png", "orphan")]


def test_deck_compare_by_key_and_by_place(spark):
    schema = "deck int, n int, key string, text string"
    ours = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y"), (2, 1, "a", "x"), (2, 2, "b", "y"), (3, 1, None, "x")], schema)
    theirs = spark.createDataFrame([(1, 1, "b", "z"), (1, 2, "a", "x"), (1, 3, "c", "q"), (2, 1, None, "x"), (2, 2, "b", None)], schema)
    got = {(r.deck, r.slide): (r.status, r.faults) for r in checks.deck_compare(ours, theirs, "deck", ["text"]).collect()}
    assert got == {(1, "a"): ("match", ""), (1, "b"): ("drift", "text"), (1, "c"): ("extra", ""), (2, "1"): ("match", ""), (2, "2"): ("drift", "text"), (3, "1"): ("missing", "")}


def test_implied_loci_skip_books_without_the_chapter(spark):
    bare = spark.createDataFrame([(1, 30, 16, 2), (1, 5, 1, 1)], "k int, at int, chapter int, verse int")
    named = spark.createDataFrame([(1, 0, "genesis"), (1, 20, "jude")], "k int, at int, section string")
    chapters = spark.createDataFrame([("genesis", 1), ("genesis", 16), ("jude", 1)], "section string, chapter int")
    assert sorted((r.at, r.section) for r in checks.implied_loci(bare, named, chapters, "k").collect()) == [(5, "genesis"), (30, "genesis")]
    ranges = checks.neighbour_ranges(spark.createDataFrame([("l", 1)], "locus string, verse int"), reach=2).orderBy("tried").collect()
    assert [(r.lo, r.hi) for r in ranges] == [(1, 2), (1, 3), (0, 1), (0, 2), (0, 3)]


def test_content_presence_and_decisions(spark):
    long = "It's a paragraph that is long enough to be looked for."
    lines = spark.createDataFrame([(1, long), (1, "short"), (2, long)], "k int, text string")
    pages = spark.createDataFrame([(1, "<p>It’s a <i>para</i>graph that is long\nenough to be looked for .</p>")], "k int, page string")
    assert sorted(tuple(r) for r in checks.content_presence(lines, pages, "k").collect()) == [(1, 1, 0), (2, 1, 1)]
    states = spark.createDataFrame([(1, "b", "d", "l"), (2, "b", "d", "l"), (3, "b", "d", "l")], "k int, base string, draft string, live string")
    takes = spark.createDataFrame([(1, "draft"), (2, "live")], "k int, take string")
    assert sorted((r.k, r.base) for r in checks.resolved(states, takes, ["k"]).collect()) == [(1, "l"), (2, "d"), (3, "b")]


def test_index_round_trip(spark, tmp_path):
    path = str(tmp_path / "index")
    files.write_index(spark.createDataFrame([("gen", 1, 2, "In the\tbeginning")], "a string, b int, c int, d string"), path)
    (tmp_path / "index" / "more.txt").write_text("p. 3\tpage text\nodd line\n\n")
    got = {(r.locator, r.section, r.chapter, r.verse, r.text, r.unparsed) for r in files.read_index(spark, path).collect()}
    assert got == {(None, "gen", 1, 2, "In the beginning", None), ("p. 3", None, None, None, "page text", None), (None, None, None, None, None, "odd line")}


def test_manifest_rows_keep_what_they_cannot_read(spark):
    rows = ["| File | B | W | E | A | R |", "|---|---|---|---|---|---|", "| [x](d/f.pdf) | a \\| b | w | e | 2026 | ok |", "| f | too few |", "after"]
    got = files.manifest_rows(spark.createDataFrame(list(enumerate(rows, 1)), "line int, value string")).orderBy("line").collect()
    assert [(r.line, r.file, r.book, r.redistribution) for r in got] == [(3, "f.pdf", "a | b", "ok"), (4, None, None, None)]
    assert got[1].unparsed == rows[3]


def test_sitemap_files_and_references(spark, tmp_path):
    xml = "<loc>https://x.org/b/</loc><loc>https://x.org/b/one/</loc><loc>https://x.org/b/tag/t</loc><loc>https://y.org/b/no</loc><loc>https://x.org/b/one</loc>"
    assert spark.createDataFrame([(xml,)], "x string").select(files.sitemap_slugs(F.col("x"), "https://x.org/b/").alias("s")).first().s == ["one"]
    for name, body in (("pieces/one/draft.md", "a<!-- x\ny -->b"), ("pieces/one/log/old.md", "no"), ("pieces/one/corrections.md", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert [(r.slug, r.text) for r in files.markdown(spark, str(tmp_path)).collect()] == [("one", "ab")]
    assert {r.size for r in files.tree(spark, str(tmp_path), "*.md").collect()} == {2, 14}
    texts = spark.createDataFrame([("talk", "a"), ("piece", "a"), ("talk", "b")], "kind string, slug string")
    got = {r.ref: r.kind for r in files.resolved_refs(spark.createDataFrame([("a",), ("talk/a",), ("b",), ("c",)], "ref string"), texts).collect()}
    assert got == {"a": "piece", "talk/a": "talk", "b": "talk", "c": None}
    envelopes = spark.createDataFrame([("x", "00")], "scan string, sha256 string")
    assert files.scan_faults(envelopes).count() == 1


def test_source_aliases(spark):
    shelf = spark.createDataFrame(
        [("a", "*The Spiritual Exercises of Saint Somebody* — **Old Writers of Asia vol. X**, tr. **Marmaduke Pickthall**"), ("b", "**Plain Name** — “An Article of Christmas” by Griffith, English"), ("c", None), ("d", "")],
        "source string, work string",
    )
    got = {(r.source, r.alias): r.weight for r in checks.source_aliases(shelf, ["english"]).collect()}
    assert got[("a", "the spiritual exercises of saint somebody")] == 100
    assert got[("a", "the spiritual exercises")] == got[("a", "the spiritual exercises of")] == 80
    assert got[("a", "marmaduke pickthall")] == 60 and got[("a", "pickthall")] == 40 and got[("a", "old writers of")] == 50
    assert not {x for s, x in got if s == "a"} & {"writers", "spiritual"}
    assert {x: w for (s, x), w in got.items() if s == "b"} == {"plain name": 60, "griffith": 40}
    assert {s for s, _ in got} == {"a", "b"}
