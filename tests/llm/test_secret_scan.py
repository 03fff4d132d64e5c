import base64
import hashlib
import random
import re

import pytest
from tests.llm.cases import SCHEMA, documents

from corpusloom.llm import secret_scan as S


def brute_base(text):
    """The patterns as they are stated, with the failing matches dropped afterwards."""
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    word = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    found = [("assign", m) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 8]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(found, key=lambda x: (x[1].start(), S.KINDS.index(x[0])))]


ODD = [
    "token = \"0123456789abcdef0123456789abcdef\" é token=secret: abcdefghij", "PassWord:abcdefgh api_key='x.y/z+1234' APIKEY==== apikey = ========", "AKIAAKIAAKIAAKIA AKIA123 xAKIA12345678ABCDz", "f" * 31 + " " + "f" * 32 + "g",
    "toKen=abcdefgh paſſword=abcdefgh", "token" + " " * 5000 + "=" + "a" * 9, "\U0001F600 secret:AAAAAAAAAA", "token=short token=longenough", "0123456789abcdef" * 4000, "=" * 40, "", None,
]


def words(r, n):
    return [r.choice(["natio", "tion", "enstand", "wort", "under", "ation", "ung", "keit", "schaft", "able"]) + "".join(r.choice(["en", "er", "tion", "heit", "ment", "de"]) for _ in range(r.randint(1, 8))) for _ in range(n)]


def planted():
    """Documents of writing, with long compounds, paths and numbers, and of secrets of several encodings; the latter's ids."""
    r = random.Random(11)
    rows, secret = [], {}
    for i in range(400):
        text = words(r, 60) + ["/".join(words(r, 3)), "-".join(words(r, 2)), str(r.randrange(10**15, 10**16)), f"chapter-{i}-of-the-long-report-2024"]
        if i % 8 == 0:
            data = bytes(r.randrange(256) for _ in range(30))
            one = [base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode(), base64.b32encode(data).decode(), data[:12].hex()][i // 8 % 4]
            text.insert(r.randrange(len(text)), one)
            secret[i] = one
        rows.append((i, " ".join(text), "en", "a", 0, 1, "x"))
    return rows, secret


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_base_spans_equal_brute_force(spark):
    rows = documents() + [(1000 + i, t, "", "", 0, 0, "") for i, t in enumerate(ODD)]
    got = by_id(S.secret_scan(spark.createDataFrame(rows, SCHEMA)))
    for doc_id, text, *_ in rows:
        want = brute_base(text)
        kinds = [w.split(":")[0] for w in want]
        r = got[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in S.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == want
    assert len(got) == len(rows)


def test_random_strings_are_found_and_writing_is_not(spark):
    rows, secret = planted()
    got = by_id(S.secret_scan(spark.createDataFrame(rows, SCHEMA)))
    found = {i: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for i, r in got.items()}
    hits = {i for i, spans in found.items() if spans}
    assert hits <= set(secret) and len(hits) >= 0.8 * len(secret)
    for i in hits:
        assert [rows[i][1][a:b] for a, b in found[i]] == [secret[i]]


def test_verdicts_equal_a_plain_calculation(spark):
    """Bands, shares of writing and the Benjamini-Hochberg step written out over sorted lists."""
    rows, _ = planted()
    runs = [(i, m.start(), m.end(), m[0]) for i, t, *_ in rows for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", t)]
    level = lambda s: min(S.BINS - 1, int(S.randomness(s) * S.BINS))
    writing = [(S.band(len(s)), level(s)) for *_, s in runs if not re.search("[0-9]", s)]
    mixed = [(i, a, b, S.band(len(s)), level(s)) for i, a, b, s in runs if re.search("[0-9]", s) and re.search("[A-Za-z]", s)]
    want = set()
    for k in range(S.BANDS):
        null, here, low = [], [x for x in mixed if x[3] == k], k
        while low >= 0 and len(null) < S.ENOUGH:
            null += [x for b, x in writing if b == low]
            low -= 1
        p = {x: (1 + sum(y >= x[4] for y in null)) / (1 + len(null)) for x in here}
        limit = max((v for n, v in enumerate(sorted(p.values()), 1) if v * len(p) <= S.RATE * n), default=-1)
        want |= {x[:3] for x in here if p[x] <= limit}
    found = S.secret_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, *map(int, s.split(":")[1:])) for r in found for s in r.spans.split(",") if s} == want and want


def test_battery():
    r = random.Random(4)
    p = [S.randomness("".join(r.choice(a) for _ in range(n))) for a in S.ALPHABETS[1:3] + S.ALPHABETS[5:8] for n in (24, 40, 200) for _ in range(200)]
    assert sum(x < 0.05 for x in p) < 0.1 * len(p)
    assert max(S.randomness(s) for s in ("ab" * 20, "0123456789abcdef" * 3, "A1" * 12, "aaaaaaaaaaaaaaa1", "a1b2c3d4e5f6" * 6)) < 0.05
    assert S.randomness("====" * 5) <= 1 and S.chi_squared_tail(3.841, 1) == pytest.approx(0.05, abs=0.004)


def test_empty_and_repeated(spark):
    assert S.secret_scan(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "token=abcdefgh1", "", "", 0, 0, "")] * 3 + [(None, None, "", "", 0, 0, "")]
    got = S.secret_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.spans) for r in got) == [("1", 1, "assign:0:15")] * 3 + [("None", 0, "")]
