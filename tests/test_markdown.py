from pyspark.sql import functions as F

from corpusloom.operators import markdown as md

DRAFT = """title: x
---
<!-- gone -->
Some *em* and **bold** with f\\*\\*k and \\[x\\], a "quote" & <tag>.[^b]

![an "alt" text](images/a.png)

- one
  goes on
- two [^a]

[^b]: First note † Verify the page
    joined line.

    Its second part.

A lost continuation?

> quoted [link](https://x.org/a)
> on

[^a]: Second note. Verify this one.

> quoted again [^zz][^a]

---

## Head

[^a2]: cf. [^b]
"""


def rows(spark, text=DRAFT):
    return spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")


def test_reader_view(spark):
    got = {(r.part, r.idx): (r.html, r.text, r.divided) for r in md.rendered(rows(spark), "id").collect()}
    assert got["body", 0] == ('<p>Some <em>em</em> and <strong>bold</strong> with f**k and [x], a "quote" &amp; &lt;tag&gt;.[[FNb]]</p>', 'Some em and bold with f**k and [x], a "quote" & <tag>.', False)
    assert got["body", 1][0] == "<ul><li>one goes on</li><li>two [[FNa]]</li></ul>"
    assert got["body", 2][0] == "<p>A lost continuation?</p>"
    assert got["body", 3][0] == '<blockquote><p>quoted <a href="https://x.org/a">link</a> on</p><p>quoted again [[FNzz]][[FNa]]</p></blockquote>'
    assert got["body", 4] == ("<h2>Head</h2>", "Head", True)
    assert got["fns", 0][1] == "First note Its second part." and got["fns", 1][1] == "Second note."
    assert len(got) == 7


def test_figures_are_mapped_and_described(spark):
    df = spark.createDataFrame([('![a "b"](images/a.png) and ![c](images/c.png)',)], "t string")
    images, captions = (F.create_map(F.lit("images/a.png"), F.lit(x)) for x in ("https://cdn.org/a", "Means this"))
    assert df.select(md.inline(F.col("t"), images, captions)).first()[0] == '<figure><img src="https://cdn.org/a" alt="a &quot;b&quot;"><figcaption>Means this</figcaption></figure> and <figure><img src="images/c.png" alt="c"></figure>'


def test_notes_and_issues(spark):
    blocks = md.parsed(rows(spark), "id")
    assert [(r.label, r.number, r.text, r.removed) for r in md.ordered_notes(blocks, "id").orderBy("number").collect()] == [("b", 1, "First note Its second part.", "Verify the page joined line."), ("a", 2, "Second note.", "Verify this one.")]
    assert sorted((r.label, r.issue) for r in md.note_issues(blocks, "id").collect()) == [("a", "duplicated"), ("a2", "unreferenced"), ("b", "nested"), ("b", "orphaned"), ("zz", "undefined")]
    assert md.residual(md.rendered(rows(spark, "checked 2026-09-07\n\n![2026-09-07](a.png)\n\nx[^1]\n\n[^1]: we verify it\n\n[^2]: accessed on 3 May"), "id")).count() == 2


def test_spans_follow_their_notes(spark):
    text = '**bold is no quotation** *short* and *a long italic run*[^1], then "a quoted sentence here"[^2] and "one without a mark after"'
    got = md.spans_by_note(spark.createDataFrame([(1, 0, text), (1, 1, '"nothing refers to this one"')], "id long, para int, text string"), "id").collect()
    assert sorted((r.label, r.span) for r in got) == [("1", "a long italic run"), ("2", "a quoted sentence here"), ("2", "one without a mark after")]
    both = spark.createDataFrame([('[*A Title of Work*](u) *a dharma run here* "said a *dharma* man" "a dharma run, here"',)], "t string").select(md.locus_spans(F.col("t"))).first()[0]
    assert both == ["a dharma run here", "said a dharma man"]


def test_addresses(spark):
    text = "x\n---\n[a](https://a.org/x) <https://b.org/y> https://c.org/z. `https://d.org/` https://a.org/x!"
    r = spark.createDataFrame([(text,)], "t string").select(md.urls(F.col("t")).alias("u"), md.unrenderable(F.col("t")).alias("n")).first()
    assert r.u == ["https://a.org/x", "https://b.org/y", "https://c.org/z", "https://d.org/"] and sorted(r.n) == ["https://b.org/y", "https://c.org/z", "https://d.org/"]
