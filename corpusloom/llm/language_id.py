"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed character n-grams of one to three characters of the whole lower-cased text, weighted by
1 + log(count) and inverse document frequency, at unit length. Document frequencies are counted over every document that may
be learned from. Weights are fitted on about `max_rows` of those (chosen by a hash of doc_id), and on `least` rows of each language
or all that it has, so that rare languages are learned too, by follow-the-regularised-leader with elastic-net penalties, which sets most weights to zero; a fifth of the sample is kept out to calibrate the temperature
that divides the scores. The model is of fixed size (DIMENSIONS for each language) and is broadcast; every document is scored
whole, without a shuffle.

Learned from are only the texts and languages of documents with a language whose crc32 of doc_id, as text, modulo `folds` is not
`held`. A prediction uses the text alone.

Nulls and ties: a null text, or one without a letter, is `und` with score 0. A document with a null id is not learned from and not
held out. Without anything to learn from, all are `und`. An empty table gives an empty result; other columns are ignored."""

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import small_batches

DIMENSIONS = 1 << 14
MAX_ROWS = 4000
#: Rows of a language in the sample at least, as far as there are any.
LEAST = 200
#: Characters that are counted at once.
BLOCK = 1 << 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1.0, 0.5
FOLDS, HELD = 4, 2
UNKNOWN = "und"


def counts_of(text: str, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of a text and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(dimensions, np.int64)
    for start in range(0, len(points), BLOCK):
        part = points[start : start + BLOCK + 2]  # grams that start in the block may end beyond it
        gram = np.zeros(len(part), np.uint64)
        for n in range(1, min(3, len(part)) + 1):
            gram = gram[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(n)
            own = ((gram[:BLOCK] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) % np.uint64(dimensions)
            counts += np.bincount(own.astype(np.int64), minlength=dimensions)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        return x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def chances(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        scores = (self.weights[:, found] @ self.vector(found, counts) + self.weights[:, -1]) / self.temperature
        e = np.exp(scores - scores.max())
        return e / e.sum()


def fit(languages: list[str], idf: np.ndarray, rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> LanguageModel:
    """rows: (language, features, counts). Every fifth row calibrates; the order is the rows' own."""
    k, d = len(languages), len(idf) + 1
    model = LanguageModel(languages, idf, np.zeros((k, d)))
    z, n = np.zeros((k, d)), np.zeros((k, d))
    place = {x: i for i, x in enumerate(languages)}
    data = [(place[lang], np.append(found, d - 1), np.append(model.vector(found, counts), 1.0)) for lang, found, counts in rows]
    learn, held = [x for i, x in enumerate(data) if i % 5], [x for i, x in enumerate(data) if not i % 5]

    def weights(at):
        w = -(z[:, at] - np.sign(z[:, at]) * L1) / ((BETA + np.sqrt(n[:, at])) / ALPHA + L2)
        return np.where(np.abs(z[:, at]) > L1, w, 0.0)

    for _ in range(epochs):
        for y, at, x in learn:
            w = weights(at)
            scores = w @ x
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            g2 = g * g
            z[:, at] += g - (np.sqrt(n[:, at] + g2) - np.sqrt(n[:, at])) / ALPHA * w
            n[:, at] += g2
    model.weights = weights(np.arange(d))
    scores = np.array([model.weights[:, at] @ x for _, at, x in held or learn]).reshape(-1, k)
    truth = np.array([y for y, _, _ in held or learn], int)

    def loss(t):
        s = scores / t
        top = s.max(1)
        return float((np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(s)), truth]).mean()) if len(s) else 0.0

    model.temperature = float(min(np.geomspace(0.02, 20, 121), key=loss))
    return model


def _frequencies(batches):
    total, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            found, _ = counts_of(text.as_py() or "")
            total[found] += 1
            rows += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["f", "n"])


def _features(batches):
    for batch in batches:
        got = [counts_of(x.as_py() or "") for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([x[0].astype(np.int32) for x in got], pa.list_(pa.int32())), pa.array([x[1].astype(np.int32) for x in got], pa.list_(pa.int32()))], ["doc_id", "lang", "f", "n"])


def fold(docs: DataFrame, folds: int = FOLDS):
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(folds))


def train(docs: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS, held: int = HELD, least: int = LEAST) -> LanguageModel | None:
    own = docs.where((fold(docs, folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    totals = own.select("text").mapInArrow(_frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(totals.column("f").to_pylist(), totals.column("n").to_pylist(), strict=True))
    rows = df.pop(-1, 0)
    if not rows:
        return None
    idf = np.log(1 + rows) - np.log1p([df.get(i, 0) for i in range(DIMENSIONS)]) + 1
    # A row for each language, of which the model has some sixteen thousand weights.
    sizes = own.groupBy(F.col("lang").alias("__lang")).agg(F.count(F.lit(1)).alias("__n"))
    share = F.greatest(F.lit(min(1.0, max_rows / rows)), F.least(F.lit(1.0), F.lit(float(least)) / F.col("__n")))
    chosen = own.join(F.broadcast(sizes), F.col("lang") == F.col("__lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.floor(share * (1 << 30))).select("doc_id", "lang", "text")
    sample = chosen.mapInArrow(_features, "doc_id long, lang string, f array<int>, n array<int>").toArrow()
    got = sorted(zip(*(sample.column(c).to_pylist() for c in ("doc_id", "lang")), range(sample.num_rows), strict=True), key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) % (1 << 64), r[1]))
    f, n = sample.column("f").combine_chunks(), sample.column("n").combine_chunks()
    if not got:
        return None
    examples = [(lang, np.asarray(f[i].values), np.asarray(n[i].values)) for _, lang, i in got]
    return fit(sorted({lang for _, lang, _ in got}), idf, examples)


def _predicted(batches, model):
    import regex

    letter = regex.compile(r"\p{L}")
    own = model.value
    for batch in batches:
        languages, scores = [], []
        for x in batch.column("text"):
            text = x.as_py()
            if own is None or not text or not letter.search(text):
                languages.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = own.chances(*counts_of(text))
            best = int(p.argmax())
            languages.append(own.languages[best])
            scores.append(float(p[best]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def language_id(docs: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """For each document doc_id, held_out, lang_pred and score (the calibrated chance of lang_pred)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, max_rows, folds, held))
    rows = docs.select("doc_id", F.coalesce(fold(docs, folds) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(partial(_predicted, model=model), "doc_id long, held_out boolean, lang_pred string, score double")
