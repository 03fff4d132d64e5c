import pytest

from corpusloom.operators import commonmark as cm
from corpusloom.operators import history

#: Blocks and how many of their asterisks a strict reading leaves.
CASES = [
    ("*a b*", 0), ("a * b *", 2), ("a*\"b\"*", 2), ("* a *", 1), ("foo*bar*", 0), ("5*6*78", 0), ("*a b *", 2), ("*(*a)", 2), ("*(*a*)*", 0), ("**a b**", 0), ("** a b**", 4), ("a**\"b\"**", 4), ("**a b **", 4),
    ("*a\nb*", 0), ("*a **b** c*", 0), ("*a**b**c*", 0), ("*a**b*", 2), ("***a** b*", 0), ("a***b***c", 0), ("a***b*********c", 6), ("**a*", 1), ("*a**", 1), ("***a**", 1), ("****a*", 3), ("**a***", 1), ("*a****", 3),
    ("*a _b* c_", 0), ("**a *b c**", 1), ("*a [b*](u)", 2), ("[a *b](u*) c*", 2), ("*[a](u)*", 0), ("![*a](u) b*", 1), ("[a*](<u*>)", 1), ("*<img src=\"*\"/>", 1), ("**<https://a.b/?q=**>", 2), ("*a `*`*", 0), ("`a *` b*", 1), ("``a`*`` b", 0),
    ("`a * b", 1), ("\\*a\\*", 0), ("*a\\*", 1), ("***", 0), ("* a\n* b*", 1), ("- *a\n- b*", 2), ("    a * b", 0), ("> *a\n> b*", 0), ("# *a*", 0), ("1. a*", 1), ("*a*\n***\n*b", 1), ("[x][*] *", 2), ("a*b_c*d_", 0), ("", 0), ("a" + "**" * 3000 + "b", 6000), ("**" * 300, 0), ("*a " * 2000, 2000), ("*a* " * 2000, 0),
]


@pytest.mark.parametrize("block,want", CASES, ids=range(len(CASES)))
def test_stray_asterisks(block, want):
    assert cm.stray_in_block(block) == want


def test_blocks(spark):
    rows = spark.createDataFrame([(1, "a *b"), (2, "*a*"), (3, None), (4, "the `a sound"), (5, "the `a` sound"), (6, "a `á sound\nand `x`")], "id int, src string")
    assert {(r.id, r.stars, r.tick) for r in cm.strict_marks(rows).collect()} == {(1, 1, False), (4, 0, True), (6, 0, True)}


def test_rendered_revisions(spark):
    """Intervals of drafts as readers see them, and the revision that a live copy matches."""
    texts = ["one *a*\n\ntwo", "one a\n\ntwo\n\nthree", "one a\n\nolder"]
    revs = history.rendered_rows(spark.createDataFrame([(1, f"r{i}", i, t) for i, t in enumerate(texts)], "k int, rev string, age int, text string"), "k")
    found = history.intervals(revs, "k").where("kind = 'row'").collect()
    assert sorted((r["at"], r.since, r.until) for r in found) == [(0, 0, 2), (1, 0, 1), (1, 2, 2), (2, 1, 1)]
    marks = sorted((r["at"], r.since, r.until) for r in history.intervals(revs, "k").where("kind = 'mark'").collect())
    assert marks == [(0, 0, 0), (0, 1, 2), (1, 0, 1), (1, 2, 2), (2, 1, 1)]
    for i in range(3):
        live = revs.where(f"age = {i}").select("k", "rows", "marks")
        best = history.matching(history.intervals(revs, "k"), history.sizes(revs, "k"), live, "k").first()
        assert (best.rev, best.matched) == (f"r{i}", len(texts[i].split("\n\n")))
