import random
import re
from collections import Counter

import numpy as np
from tests.llm.cases import SCHEMA, documents

from corpusloom.llm.quality_rules import IsolationForest, keep_good, quality_rules


def brute(d, t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed)


def test_counts(spark):
    rows = documents() + [(900, "a b\na b\n\n \na b \nc # $ | b\n" * 3, "en", "s", 1, 1, "k")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(brute(r[0], r[1]) for r in rows)
    assert all(r.kept == (not r.base_failed) for r in got)


def labelled(n=400, seed=2):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(1, 9))) for _ in range(r.randint(60, 300))]
        bad = i % 8 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad and i % 16 else " | ".join(words) if bad else " ".join(w.capitalize() + "." if r.random() < 0.1 else w for w in words)
        rows.append((i, text, "en", "s", len(text), 1, "k"))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_forest_finds_the_bad(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, SCHEMA)
    half = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(docs, half).collect()}
    good = [got[i].kept for i, q, _ in labels if q]
    bad = [got[i].kept for i, q, _ in labels if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05
    kept = keep_good(docs, half)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_forest_is_deterministic():
    x = np.random.default_rng(0).normal(size=(300, 3)) * 0.05 + 0.5
    low, high = np.zeros(3), np.ones(3)
    a, b = (IsolationForest.fit(x, low, high).path(x[:20]) for _ in range(2))
    assert (a == b).all()
    assert IsolationForest.fit(x, low, high).path(np.array([[0.95, 0.95, 0.05]]))[0] < a.min()


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules(empty, labels).count() == 0
    assert keep_good(empty, labels).count() == 0
