"""Quality rules: an isolation forest over rule statistics, calibrated on labelled rows.

Each document gives counts (words, symbols, repeated lines, repeated three-word windows, letters, capitals, ...). Their ratios
are the forest's features; those that lie near nought in clean text are taken on a logarithmic scale, so that a random split
is as likely to fall between none and a few as between a few and many. A tree splits the box of the labelled rows' features at
random, feature by feature; a document's path ends where its cell holds at most one training row or at the depth limit, and
the rows left in the cell add the length that an unsuccessful search among them would take. Trees are grown on random samples
of the rows labelled good, so cells where such documents do not lie end paths early. Documents whose mean path is short are
anomalous. The threshold is the one that separates the labelled rows best, with a good row's loss weighing GOOD_WEIGHT times a
bad row's; it is chosen on half of the labelled rows, which no tree has seen.

The forest is fitted on at most `max_rows` labels (those first by a hash of doc_id), which are broadcast; only their documents
are counted for it. Counts and verdicts then cover every document whole, in one pass without a shuffle.

Nulls and ties: a null or empty text has no words and fails the base rule; a null id is judged like any other. Repeated rows
are judged alike. Without labelled rows of both kinds the forest gives no verdict and only the base rule decides; where one
half of the labelled rows lacks a kind, all of them serve as both halves. An empty table gives an empty result; other columns
are ignored."""

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textarrays as ta
from corpusloom.llm.scratch import small_batches

#: Documents with fewer words, or with more than this percentage of repeated words, fail the base rule.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Labelled rows that the forest is fitted on, at most.
MAX_ROWS = 20_000
TREES = 200
SAMPLE = 256
DEPTH = 10
GOOD_WEIGHT = 50
SEED = 17

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks", "n_digits")


def _flags(test) -> np.ndarray:
    return np.array([test(chr(b)) if b < 128 else False for b in range(256)])


SYMBOLS = _flags(lambda c: c in "#*$%&|<>")
CAPITALS = _flags(str.isupper)
LETTERS = _flags(str.isalpha)
LETTERS[0xC0:] = True  # the first byte of a character outside ASCII counts as a letter
MARKS = _flags(lambda c: c in "!?;:()[]{}=+~^_@\\/\"")
DIGITS = _flags(str.isdigit)


def _by_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def text_counts(c: ta.Chunk) -> np.ndarray:
    """The COUNTS of each text of a chunk."""
    hashes, bounds = c.words()
    data = c.data
    space = (data == 32) | ((data - np.uint8(9)) < 5)
    out = np.zeros((c.size, len(COUNTS)), np.int64)
    out[:, 0] = np.diff(bounds)
    out[:, 1] = _by_text(~space & ((data & 0xC0) != 0x80), c.bounds)
    for j, flags in ((2, SYMBOLS), (6, CAPITALS), (7, LETTERS), (8, MARKS), (9, DIGITS)):
        out[:, j] = _by_text(flags[data], c.bounds)
    for i in range(c.size):
        lines = [x for x in c.text(i).split(b"\n") if x.strip()]
        out[i, 5] = len(lines)
        out[i, 3] = len(lines) - len(set(lines))
    grams = ta.rolling_hash(hashes, 3)
    if len(grams):
        owner = ta.owners(bounds)
        own = owner[: len(grams)]
        inside = np.flatnonzero(own == owner[2:])
        keys = grams[inside] ^ ta.mix(own[inside].astype(np.uint64))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        repeated = inside[counts[inverse] > 1]
        covered = np.zeros(len(hashes), bool)
        for j in range(3):
            covered[repeated + j] = True
        out[:, 4] = _by_text(covered, bounds)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios between 0 and 1; those of symbols, repeats, marks and digits on a logarithmic scale."""
    n = counts.astype(np.float64)
    words, chars, lines, letters = (np.maximum(n[:, j], 1) for j in (0, 1, 5, 7))

    def scaled(ratio: np.ndarray) -> np.ndarray:
        return np.log1p(100 * ratio) / np.log1p(100)

    return np.stack(
        [
            scaled(np.minimum(n[:, 2] / words, 2) / 2),
            scaled(n[:, 3] / lines),
            scaled(n[:, 4] / words),
            np.minimum(n[:, 1] / words, 20) / 20,
            n[:, 6] / letters,
            scaled(np.minimum(n[:, 8] / words, 2) / 2),
            scaled(n[:, 9] / chars),
            n[:, 7] / chars,
        ],
        axis=1,
    )


def search_length(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as arrays: feature (-1: a leaf), split, children, and a leaf's path length."""

    trees: list
    threshold: float | None = None

    @classmethod
    def fit(cls, good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH, seed: int = SEED):
        r = np.random.default_rng(seed)
        grown = []
        for _ in range(trees):
            rows = good[r.choice(len(good), min(sample, len(good)), replace=False)]
            nodes: list[list] = []

            def grow(rows, low, high, level, nodes=nodes):
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, 0.0])
                if level >= depth or len(rows) <= 1:
                    nodes[at][4] = level + float(search_length(len(rows)))
                    return at
                f = int(r.integers(len(low)))
                split = float(r.uniform(low[f], high[f]))
                left = rows[:, f] < split
                cell_high, cell_low = high.copy(), low.copy()
                cell_high[f] = cell_low[f] = split
                nodes[at][:2] = f, split
                nodes[at][2] = grow(rows[left], low, cell_high, level + 1)
                nodes[at][3] = grow(rows[~left], cell_low, high, level + 1)
                return at

            grow(rows, low, high, 0)
            n = list(zip(*nodes, strict=True))
            grown.append((np.array(n[0]), np.array(n[1]), np.array(n[2]), np.array(n[3]), np.array(n[4])))
        return cls(grown)

    def path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row."""
        total = np.zeros(len(x))
        for feature, split, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while len(inner := np.flatnonzero(feature[at] >= 0)):
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] < split[node], left[node], right[node])
            total += length[at]
        return total / len(self.trees)

    def calibrate(self, x: np.ndarray, good: np.ndarray, weight: float = GOOD_WEIGHT) -> None:
        """The threshold between path lengths that costs least: rows below it are rejected."""
        path = self.path(x)
        by = np.argsort(path, kind="stable")
        path, good = path[by], good[by]
        lost = np.concatenate([[0], np.cumsum(good)]) / max(1, good.sum()) * weight
        passed = 1 - np.concatenate([[0], np.cumsum(~good)]) / max(1, (~good).sum())
        between = np.concatenate([[True], path[1:] > path[:-1], [True]])
        best = int(np.argmin(np.where(between, lost + passed, np.inf)))
        self.threshold = float((path[best - 1] + path[best]) / 2) if 0 < best < len(path) else float(path[0] - 1 if best == 0 else path[-1] + 1)

    def keeps(self, x: np.ndarray) -> np.ndarray:
        return self.path(x) >= self.threshold


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED_PERCENT * counts[:, 0])


COUNT_SQL = ", ".join(f"{c} long" for c in COUNTS)


def _counted(batches):
    for batch in batches:
        counts = [text_counts(c) for c in ta.chunks(batch.column("text"))]
        if counts:
            counts = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *(pa.array(counts[:, j].copy()) for j in range(len(COUNTS)))], ["doc_id", "quality", *COUNTS])


def _judged(batches, forest):
    model = forest.value if forest is not None else None
    for batch in batches:
        counts = [text_counts(c) for c in ta.chunks(batch.column("text"))]
        if not counts:
            continue
        counts = np.concatenate(counts)
        failed = base_failed(counts)
        path = model.path(features(counts)) if model is not None else np.full(len(counts), np.nan)
        yield batch, counts, failed, ~failed & (path >= model.threshold if model is not None else True), path


def _verdicts(batches, forest):
    for batch, counts, failed, kept, path in _judged(batches, forest):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, j].copy()) for j in range(5)), pa.array(failed), pa.array(kept), pa.array(path)], ["doc_id", *COUNTS[:5], "base_failed", "kept", "path"])


def _kept_rows(batches, forest):
    for batch, _, _, kept, _ in _judged(batches, forest):
        yield batch.filter(pa.array(kept))


def fitted(x: np.ndarray, good: np.ndarray, first: np.ndarray) -> IsolationForest | None:
    """Forest from the rows' features, grown on the half `first` and calibrated on the other."""
    if not good.any() or good.all():
        return None
    for half in (first, ~first):
        if not good[half].any() or good[half].all():
            grown = calibrating = np.ones(len(x), bool)
            break
    else:
        grown, calibrating = first, ~first
    low, high = x[grown].min(0), x[grown].max(0)
    forest = IsolationForest.fit(x[grown & good], low, np.where(high > low, high, low + 1e-9))
    forest.calibrate(x[calibrating], good[calibrating])
    return forest


def fit_forest(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> IsolationForest | None:
    """Forest and threshold from documents (doc_id, text) and labels (doc_id, quality 0 or 1)."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    # At most max_rows rows of two numbers.
    labels = F.broadcast(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    counts = docs.join(labels, "doc_id").select("doc_id", "quality", "text").mapInArrow(ta.released(_counted), f"doc_id long, quality int, {COUNT_SQL}")
    rows = counts.orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(max_rows).select((F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(2)) == 0).alias("first"), "quality", *COUNTS).toArrow()
    if not rows.num_rows:
        return None
    x = np.stack([rows.column(c).to_numpy() for c in COUNTS], 1)
    ruled = ~base_failed(x)  # what the base rule rejects needs no forest
    return fitted(features(x[ruled]), rows.column("quality").to_numpy()[ruled] > 0, rows.column("first").to_numpy()[ruled])


def _forest(docs: DataFrame, labels: DataFrame, max_rows: int):
    small_batches(docs.sparkSession)
    forest = fit_forest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, max_rows)
    return docs.sparkSession.sparkContext.broadcast(forest) if forest else None


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """For each document doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and its mean path."""
    shared = _forest(docs, labels, max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(ta.released(_verdicts, forest=shared), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, kept boolean, path double")


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    shared = _forest(docs, labels, max_rows)
    return docs.mapInArrow(ta.released(_kept_rows, forest=shared), docs.schema)
