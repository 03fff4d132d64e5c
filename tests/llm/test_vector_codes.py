import hashlib
import math
import random

import numpy as np

from corpusloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<{}>, label int, bucket int, k string"


def brute(rows, parts=8, entries=16, rounds=6):
    """Loops over Python's integers."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    if not good:
        return []
    size = len(good[0][1])
    cut = [size * p // parts for p in range(parts + 1)]
    whole = [[math.floor(4096 * x) if abs(x) < 1e300 else int(x) * 4096 for x in r[1]] for r in good]
    split = [[v[a:b] for a, b in zip(cut, cut[1:], strict=False)] for v in whole]
    books = [[v[p] for v in split[:entries]] for p in range(parts)]

    def nearest(part, p):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(v[p], p)[1] for p in range(parts)] for v in split]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, f in zip(split, found, strict=True) if f[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for r, v in zip(good, split, strict=True):
        found = [nearest(v[p], p) for p in range(parts)]
        error = min(V.MOST, sum(d for d, _ in found))
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), error, r[2]))
    return sorted(((i, c, e, min(V.MOST, by_label[g]), digest) for i, c, e, g in out), key=str)


def found(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(3)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.vector_codes(df, **options).collect()), key=str)


def vectors(seed, n, size, spread=0.3):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i * 7 % 1000, [float(np.float32(x + r.gauss(0, spread))) for x in middle[i % 5]], r.choice([1, 1, 1, 2, None]), 1, "x") for i in range(n)]
    return rows + rows[:4]


ODD = [(1, None, 1, 1, ""), (2, [], 1, 1, ""), (3, [1.0, None] + [0.0] * 14, 1, 1, ""), (4, [float("nan")] * 16, 1, 1, ""), (5, [float("inf")] * 16, 2, 1, ""), (6, [0.5] * 17, 2, 1, ""), (None, [0.25] * 16, None, 1, ""), (None, [0.25] * 16, None, 1, "")]


def test_equals_brute_force(spark):
    rows = vectors(1, 150, 16) + [(i + 7 if i is not None and i < 7 else i, *rest) for i, *rest in ODD if rest[0] != []]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, "double", rounds=2) == brute(rows, rounds=2)


def test_lengths_and_few_vectors(spark):
    for n, size in ((5, 16), (40, 11), (30, 3), (1, 8)):
        rows = vectors(2, n, size)[:n]
        assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, ODD[:1] + ODD[3:5]) == []
    assert found(spark, ODD[1:2]) == brute(ODD[1:2])


def test_ties_and_large_components(spark):
    rows = [(i, [float(i % 2)] * 8, 0, 1, "") for i in range(40)]
    assert found(spark, rows) == brute(rows)
    large = [(i, [x * 10.0**14 for x in v], *rest) for i, v, *rest in vectors(3, 30, 8)] + [(5000, [1e307] * 8, 9, 1, "")]
    assert found(spark, large, "double") == brute(large)


def test_sql_states_the_same(spark, tmp_path):
    import duckdb

    from corpusloom.llm.oracles import ORACLES

    rows = vectors(4, 60, 16) + ODD[:1] + ODD[2:5]
    spark.createDataFrame(rows, SCHEMA.format("float")).write.parquet(str(tmp_path / "e"))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    got = duckdb.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({ORACLES['op13_vector_codes']})").fetchall()
    assert sorted(got, key=str) == brute(rows)
