import random

import pytest
from tests.llm.cases import SCHEMA, documents

from corpusloom.llm.components import components
from corpusloom.llm.jaccard_join import jaccard_join, without_near_copies


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, n=5, percent=75):
    sets = {}
    for d, t, *_ in rows:
        w = lower(t or "").encode().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def crowd(seed=3, n=90):
    """A large group of near copies that drift apart, short texts, and a passage that unlike documents share."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(220)]
    rows, drift = [], list(base)
    for i in range(n):
        words = list(base)
        for _ in range(r.randint(0, 7)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        if i % 5 == 0:
            drift[r.randrange(len(drift))] = f"y{i}"
            words = list(drift)
        rows.append(" ".join(words))
    rows += [" ".join([*base[:60], *(f"z{r.randrange(10**6)}" for _ in range(r.randint(5, 40)))]) for _ in range(40)]
    rows += [" ".join(base[i : i + k]) for k in range(1, 12) for i in (0, 0, 3)]
    return [(i * 2 + 1, t, "en", "s", len(t), 1, "k") for i, t in enumerate(rows)]


@pytest.mark.parametrize("small,sample_of", [(32, 8), (2, 1)])
def test_equals_brute_force(spark, small, sample_of):
    rows = documents() + [(1000 + r[0], *r[1:]) for r in crowd()]
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA), small=small, sample_of=sample_of).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f", "en", "s", 1, 1, "k"), (1, "a b c d e f", "en", "s", 1, 1, "k"), (None, "a b c d e f", "en", "s", 1, 1, "k"), (0, "A B c d e f", "en", "s", 1, 1, "k")]
    got = sorted((tuple(r) for r in jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(0, 2, 0), (1, 2, 0), (1, 2, 0), (None, 2, None)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_join(empty).count() == 0
    assert without_near_copies(empty).count() == 0


def test_one_of_each_group_stays(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = without_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, _, c in brute(rows) if d == c)


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 300)] + [(500, i) for i in range(501, 700)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(200)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    """An unlike text of a repeated id stays; of several near copies with one id one stays."""
    r = random.Random(9)
    x, y, z = ([f"{c}{r.randrange(900)}" for _ in range(60)] for c in "xyz")
    near = lambda w: " ".join([*w[:30], "changed", *w[31:]])
    rows = [(1, " ".join(x)), (5, " ".join(x)), (5, " ".join(y)), (7, " ".join(z)), (7, near(z)), (8, " ".join(z)), (None, " ".join(x)), (9, None), (9, "")]
    docs = spark.createDataFrame([(*row, "en", "s", 1, 1, "k") for row in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in without_near_copies(docs).collect()), key=str)
    kept = [g for g in got if g[0] == 7]
    assert len(kept) == 1 and kept[0][1] in (" ".join(z), near(z))
    assert [g for g in got if g[0] != 7] == sorted([(1, " ".join(x)), (5, " ".join(y)), (None, " ".join(x)), (9, None), (9, "")], key=str)


def test_one_id_holds_many_unlike_texts_and_one_text_is_very_long(spark):
    r = random.Random(10)
    rows = [(3, " ".join(f"w{r.randrange(10**6)}" for _ in range(30))) for _ in range(300)]
    long = [f"w{r.randrange(50_000)}" for _ in range(400_000)]
    rows += [(10, " ".join(long)), (11, " ".join([*long[:-50], *(f"v{i}" for i in range(50))]))]
    docs = spark.createDataFrame([(*row, "en", "s", 1, 1, "k") for row in rows], SCHEMA)
    got = jaccard_join(docs).collect()
    assert len(got) == 302
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (10, 10), (11, 10)}
    assert without_near_copies(docs).count() == 301
