"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the characters of the lower-cased whole text
(``DIMENSIONS`` slots), weighted by (1 + ln count) * idf and normalised to length 1.
The weights are trained by follow-the-regularised-leader (FTRL-proximal, per-weight
learning rates) with elastic-net penalties, then a temperature is fitted on rows
that the training left out.

Bounds: the classifier is fitted on a sample of about ``PER_LANGUAGE`` different rows of
each language (the documented bound): those whose XXH64 of doc_id and text is below
the share PER_LANGUAGE / n of its range, n being the language's different rows, counted to
some 2 %; the document
frequencies cover all rows that may be learned from. Those are rows whose
crc32(doc_id as text) mod 3 is not 1 and whose lang is not null. Prediction reads
nothing but the text. The driver gets one count a slot and a language and the sample's
slots; the model that is broadcast has DIMENSIONS x languages weights. More than
``MAX_LANGUAGES`` different values of lang raise an error, as the model grows with them.

Plan: one pass counts languages, one counts document frequencies (a dense vector a
task, summed by slot), one picks the sample by a filter and makes it distinct (at most a
few thousand texts are shuffled), one predicts. No text but the sample's is
shuffled, and no task gets a language as a whole.

Defined results: null text or no letter = ``und`` with score 0; nothing to learn from
= ``und`` with score 0 everywhere; a single language = that language, score 1; a null
doc_id is kept as null and is in the fold of the empty text; a very long text is read
as a whole, 12 bytes a character; empty table = no rows; repeated rows get equal rows;
extra columns, whatever their names, are ignored, by ``keep_identified`` kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of

DIMENSIONS = 1 << 15
PER_LANGUAGE = 800
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2e-4, 1e-4
UNKNOWN = "und"
MAX_LANGUAGES = 512
#: keep_identified rejects scores within this share of a guess (1 / languages), but no more
#: than this share of the labelled rows that the training left out.
NO_BETTER, REJECTED = 0.02, 0.001
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"

_MULTIPLIERS = [np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)]


def slots_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's n-grams, ascending, and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.zeros(DIMENSIONS, np.int64)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, 4):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * _MULTIPLIERS[1] + c[n - 1 :] * _MULTIPLIERS[0]
        h ^= h >> np.uint32(15)
        count += np.bincount((h * _MULTIPLIERS[2]) >> np.uint32(32 - 15), minlength=DIMENSIONS)
    at = np.flatnonzero(count)
    return at, count[at]


def weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    n = float(np.sqrt(x @ x))
    return x / n if n > 0 else x


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature, self.least = languages, idf, 1.0, 0.0
        self.weights = np.zeros((DIMENSIONS + 1, len(languages)))  # the last row is the bias

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, count = slots_of(text)
        p = softmax(self.scores(at, weigh(at, count, self.idf)) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], frequency: np.ndarray, documents: int) -> Model:
    """rows: slots, counts, language. Every fifth row calibrates the temperature."""
    languages = sorted({r[2] for r in rows})
    model = Model(languages, np.log((1 + documents) / (1 + frequency)) + 1)
    label = {x: k for k, x in enumerate(languages)}
    data = [(np.append(at, DIMENSIONS), np.append(weigh(at, n, model.idf), 0.3), label[x]) for at, n, x in rows]
    held = data[::5] if len(data) >= 10 else []
    fit = [d for i, d in enumerate(data) if not held or i % 5]
    z = np.zeros_like(model.weights)
    g2 = np.zeros_like(model.weights)
    rng = np.random.default_rng(0)

    def leader(at: np.ndarray) -> np.ndarray:
        """FTRL-proximal's closed form for the weights of these slots."""
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            at, x, k = fit[i]
            w = leader(at)
            p = softmax(x @ w)
            p[k] -= 1
            g = x[:, None] * p
            old = g2[at]
            g2[at] = old + g * g
            z[at] += g - (np.sqrt(g2[at]) - np.sqrt(old)) / ALPHA * w
    model.weights = leader(np.arange(DIMENSIONS + 1))
    model.weights[-1] *= 0.3
    if held and len(languages) > 1:
        scores = np.array([model.scores(at[:-1], x[:-1]) for at, x, _ in held])
        truth = np.array([k for *_, k in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        loss = [-np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        best = softmax(scores / model.temperature).max(axis=1)
        guess = 1 / len(languages)
        model.least = min(guess + NO_BETTER * (1 - guess), float(np.quantile(best, REJECTED)))
    return model


def fold() -> Column:
    """crc32 of doc_id as text, mod 3."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 3


def fit(docs: DataFrame) -> Model:
    """The model that docs' labelled rows outside the held-out fold give."""
    rows = docs.where((fold() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.02)).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    if not counts:
        return Model([], np.ones(DIMENSIONS))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                total[slots_of(text)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["slot", "n"])

    df = np.zeros(DIMENSIONS, np.int64)
    documents = 0
    for slot, n in rows.select("text").mapInArrow(frequencies, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        if slot < 0:
            documents = n
        else:
            df[slot] = n

    # Each language's share of the hash range holds about PER_LANGUAGE of its rows.
    bits = 40
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, PER_LANGUAGE / max(n, 1)) * (1 << bits)))])
    drawn = rows.withColumn("k", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << bits)))
    chosen = drawn.where(F.col("k") < F.element_at(share, F.col("lang"))).select("text", "lang", "k").distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [slots_of(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array([a.astype("<u2").tobytes() for a, _ in found]), pa.array([n.astype("<u4").tobytes() for _, n in found])],
                names=["lang", "k", "slots", "counts"],
            )

    sample = chosen.select("text", "lang", F.col("k").cast("bigint")).mapInArrow(features, "lang string, k bigint, slots binary, counts binary").collect()
    sample.sort(key=lambda r: (r.k, r.lang, r.slots))
    return train([(np.frombuffer(r.slots, "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64), r.lang) for r in sample], df, documents)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    model = model or fit(docs)
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in slices(batches):
            got = [m.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold() == 1).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, least: float | None = None) -> DataFrame:
    """docs without the rows whose language cannot be told (``und``) or has a calibrated
    score under ``least`` (the model's own by default). The text decides, so the filter
    needs no join; columns are kept as they are."""
    model = fit(docs)
    least = model.least if least is None else least
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            got = map(held.value.predict, batch)
            yield pd.Series([x != UNKNOWN and s >= least for x, s in got], dtype=bool)

    return docs.where(told(text_of()))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
