"""Secrets in texts: assignments, access keys and hexadecimal digests by pattern, and other strings that a battery of tests can't
tell from random ones, under a false-discovery rate that knows their length.

Base spans are the patterns' matches. The method looks at every run of LEAST or more characters of base-64 alphabets. Its encoding is
the least of ALPHABETS that has all its characters (without `=` at the end). Against uniform random draws from that alphabet it is
tested for
    alphabet uniformity     chi-squared over its characters, and over capitals, small letters, digits and the rest
    runs                    of characters from the same half of the alphabet
    serial correlation      of neighbouring characters' places in the alphabet, and of pairs: how many recur
and its randomness is the least p-value times their number (1 at most). Random strings have one that is spread over 0 to 1, writing
has one near nought, and the longer the nearer.

A run without a digit is writing, and so serves as the null distribution: the p-value that a run with digits and letters is writing is the
share of writing of its length that looks as random or more. Where a length band has fewer than ENOUGH runs of writing, shorter bands'
are added: longer writing looks less random, so shorter writing makes p-values larger, never smaller. In each band the Benjamini-Hochberg rule at RATE finds the randomness from which
runs are secrets; where writing is scarce, p-values can't be small, and little is reported. Both distributions are counted over all
documents in BINS bins for each of BANDS bands: what reaches the driver is bounded by that, not by the corpus. Numbers
alone (cards, telephones) are no secrets here.

Nulls and ties: a null or empty text has no spans. Rows are judged on their own, repeated ones alike, and count in the distributions
as often as they stand. Of spans with one start, kinds are in the order of KINDS. A found run that meets a base span is not reported
again. An empty table gives an empty result; other columns are ignored."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import cut, small_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are as long as can be, so that shorter ones need not be found first.
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16
#: Characters of a run that is tested.
LEAST = 16
#: Up to how many characters recurring pairs are few enough for Poisson's distribution.
SHORT = 256
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Share of false discoveries; bins of randomness; bands of length: from LEAST on, each half as long again as the one before.
RATE, BINS, BANDS = 0.01, 200, 24
ENOUGH = 1000

DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: From the least to the largest; a run's encoding is the first that has all its characters.
ALPHABETS = (
    DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", SMALL, LARGE, LARGE + "234567", DIGITS + SMALL, DIGITS + LARGE, LARGE + SMALL, LARGE + SMALL + DIGITS, LARGE + SMALL + DIGITS + "+/", LARGE + SMALL + DIGITS + "-_",
    LARGE + SMALL + DIGITS + "+/-_=",
)


def _places(alphabet: str) -> np.ndarray:
    at = np.full(128, -1, np.int64)
    at[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
    return at


_PLACES = [_places(a) for a in ALPHABETS]
_CLASS = np.full(128, 3, np.int64)
for _k, _chars in enumerate((LARGE, SMALL, DIGITS)):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_tail(x: float, degrees: int) -> float:
    """The probability of x or more, after Wilson and Hilferty."""
    spread = 2 / (9 * degrees)
    return 0.5 * math.erfc(((x / degrees) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))


def poisson_tail(x: int, mean: float) -> float:
    """The probability of x or more."""
    if x > mean + 40 + 12 * math.sqrt(mean):
        return 0.0
    return max(0.0, 1 - sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(x)))


def uniformity(counts: np.ndarray, expected: np.ndarray) -> float:
    return chi_squared_tail(float(((counts - expected) ** 2 / expected).sum()), len(expected) - 1) if len(expected) > 1 else 1.0


def randomness(run: str) -> float:
    """How well a run of base-64 characters passes for random draws from its alphabet: 0 to 1."""
    codes = np.frombuffer((run.rstrip("=") or run).encode(), np.uint8)
    n = len(codes)
    at, alphabet = next((p[codes], a) for p, a in zip(_PLACES, ALPHABETS, strict=True) if (p[codes] >= 0).all())
    size = len(alphabet)
    sizes = np.bincount(_CLASS[np.frombuffer(alphabet.encode(), np.uint8)], minlength=4)
    classes = np.bincount(_CLASS[codes], minlength=4)[sizes > 0]
    tests = [uniformity(np.bincount(at, minlength=size), np.full(size, n / size)), uniformity(classes, sizes[sizes > 0] * n / size)]
    if n > 1:
        upper = at >= size // 2
        share = 2 * (size // 2) * (size - size // 2) / size**2  # of neighbours from different halves
        changes = int(np.count_nonzero(upper[1:] != upper[:-1]))
        tests.append(two_sided((changes - (n - 1) * share) / math.sqrt((n - 1) * share * (1 - share))))
        off = at - (size - 1) / 2
        tests.append(two_sided(float((off[1:] * off[:-1]).sum()) / ((size**2 - 1) / 12) / math.sqrt(n - 1)))
        met = np.unique(at[1:] * size + at[:-1], return_counts=True)[1]
        mean = (n - 1) * (n - 2) / 2 / size**2
        again = int((met * (met - 1) // 2).sum())
        tests.append(poisson_tail(again, mean) if n <= SHORT else 0.5 * math.erfc((again - mean) / math.sqrt(2 * mean)))
    return min(1.0, min(tests) * len(tests))


def band(length: int) -> int:
    return min(BANDS - 1, int(math.log(length / LEAST, 1.5)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' matches, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def tested_runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, band, bin of randomness, writing) of each run that is writing or has digits and letters and meets no base span."""
    out, at, reach = [], 0, []
    for m in RUN.finditer(text):
        run = m.group()
        writing = not any(c in run for c in DIGITS)
        if not writing:
            while at < len(base) and base[at][0] < m.end():
                reach.append(base[at][2])
                at += 1
            reach = [e for e in reach if e > m.start()]
            if reach or not any(c.isalpha() for c in run):
                continue
        out.append((m.start(), m.end(), band(len(run)), min(BINS - 1, int(randomness(run) * BINS)), writing))
    return out


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
TESTED = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("bin", pa.int32()), ("writing", pa.bool_())])


def _scanned(batches):
    for batch in batches:
        base, runs = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base.append(found := base_spans(text))
            runs.append(tested_runs(text, found))
        as_rows = lambda rows, kind: pa.array([[dict(zip(kind.names, x, strict=True)) for x in r] for r in rows], pa.list_(kind))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_rows(base, SPAN), as_rows(runs, TESTED)], ["doc_id", "base", "runs"])


def thresholds(counts: dict[tuple[int, int, bool], int], rate: float = RATE) -> dict[int, int]:
    """Of how many runs lie in (band, bin, writing): the least bin of each band from which runs are secrets."""
    of = lambda writing: np.array([[counts.get((b, k, writing), 0) for k in range(BINS)] for b in range(BANDS)])
    # Rows: the band; columns: how many are in the bin or a higher one.
    null, held = (np.cumsum(of(writing)[:, ::-1], axis=1)[:, ::-1] for writing in (True, False))
    for b in range(1, BANDS):
        null[b] += null[b - 1] * (null[b, 0] < ENOUGH)
    p = (null + 1) / (null[:, :1] + 1)
    good = (held > 0) & (p * held[:, :1] <= rate * held)
    return {b: int(np.argmax(good[b])) for b in range(BANDS) if good[b].any()}


def secret_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """For each document doc_id, `base` and `spans`: arrays of (start, kind: its number in KINDS, end) in order."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = cut(rows.mapInArrow(_scanned, "doc_id long, base array<struct<start int, kind int, end int>>, runs array<struct<start int, end int, band int, bin int, writing boolean>>"))
    counted = scanned.select(F.inline("runs")).groupBy("band", "bin", "writing").agg(F.count(F.lit(1)).alias("n"))
    least = thresholds({(r.band, r.bin, r.writing): r.n for r in counted.collect()}, rate)  # 2 * BANDS * BINS rows at most
    found = F.array().cast("array<struct<start int, kind int, end int>>")
    if least:
        from_bin = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
        secret = lambda r: ~r["writing"] & F.coalesce(r["bin"] >= from_bin[r["band"]], F.lit(False))
        found = F.transform(F.filter("runs", secret), lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", found)).alias("spans"))


def in_writing(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """For each document doc_id, n_assign, n_access, n_hex, base_sha256 and spans in writing."""
    found = secret_spans(docs, rate)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(in_writing(F.col("base")), 256).alias("base_sha256"), in_writing(F.col("spans")).alias("spans"))
