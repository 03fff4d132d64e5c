import math
import random
import zlib
from collections import Counter

import numpy as np
from tests.llm.cases import SCHEMA, documents

from corpusloom.llm.language_id import DIMENSIONS, counts_of, fit, language_id

SYLLABLES = {"en": ["the", "ing", "wh", "th", "er", "ed", "on"], "de": ["ung", "sch", "ein", "ä", "ß", "ver", "en"], "fr": ["eau", "é", "tion", "oi", "le", "eux", "de"]}


def rows(n=600, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        text = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(15, 120)))
        out.append((i, text, lang if i % 11 else None, "s", len(text), 1, lang))
    return out


def test_counts():
    text = "Abba é"
    grams = Counter(text.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1))
    found, counts = counts_of(text)
    assert counts.sum() == sum(grams.values()) and len(found) <= len(grams)
    assert len(counts_of("")[0]) == 0 and counts_of("x")[1].tolist() == [1]


def test_held_out_accuracy(spark):
    data = rows()
    got = language_id(spark.createDataFrame(data, SCHEMA)).collect()
    truth = {d: k for d, *_, k in data}
    assert len(got) == len(data)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    # calibrated: the mean chance is near the share of right predictions
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == truth[r.doc_id] for r in held])) < 0.08
    swapped = [(d, t, ("en" if zlib.crc32(str(d).encode()) % 4 == 2 else lang), *x) for d, t, lang, *x in data]
    again = language_id(spark.createDataFrame(swapped, SCHEMA)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_penalties_leave_few_weights():
    r = np.random.default_rng(0)
    examples = []
    for i in range(400):
        found = np.sort(r.choice(1000, 30, replace=False)) + 10
        y = "a" if i % 2 else "b"
        examples.append((y, np.concatenate([[1 if y == "a" else 2], found]), np.ones(31, int)))
    model = fit(["a", "b"], np.ones(DIMENSIONS), examples)
    assert (model.weights != 0).mean() < 0.02
    assert model.chances(np.array([1]), np.array([1]))[0] > 0.8 and math.isfinite(model.temperature)


def test_odd_rows(spark):
    data = documents() + [(700, "1234 !!! 55", "en", "s", 1, 1, "k"), (None, "the thing", "en", "s", 1, 1, "k")]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(data, SCHEMA)).collect()}
    for d, t, *_ in data:
        if not t or not any(c.isalpha() for c in t):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
        else:
            assert got[d].lang_pred in ("en", "de")
    assert got[None].held_out is False
    assert language_id(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None, "s", 1, 1, "k")], SCHEMA)
    assert language_id(unlabelled).collect()[0].lang_pred == "und"


def test_rare_languages_are_learned(spark):
    """A language of one row in a hundred is in the sample, however small that is."""
    r = random.Random(4)
    data = rows(1500)
    rare = [(5000 + i, " ".join("".join(r.choice(["xq", "zw", "kj"]) for _ in range(2)) for _ in range(40)), "xx", "s", 1, 1, "xx") for i in range(15)]
    got = language_id(spark.createDataFrame(data + rare, SCHEMA), max_rows=150).collect()
    held = [x for x in got if x.doc_id >= 5000 and x.held_out]
    assert held and all(x.lang_pred == "xx" for x in held)


def test_long_texts_are_counted_whole():
    text = "aé日b" * 200_000
    found, counts = counts_of(text)
    assert counts.sum() == 3 * len(text) - 3
    short, one = counts_of("aé日b" * 3)
    assert set(short) == set(found) and len(one) == len(counts)
