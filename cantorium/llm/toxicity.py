"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, pairs of neighbouring words and pairs of words with one between, hashed to a fixed
number of coordinates, each counted once. Every coordinate has its own learning rate, and the L1 term keeps most weights
at zero, so the model is a short list of coordinates and weights that is sent to every task.

Training is sequential, so it runs in one task over a bounded sample of the labelled rows: at most MOST_ROWS rows, those
whose hashes are smallest, with one for each different text of an id, and of their features at most MOST_FEATURES
coordinates, in that order (a row that would exceed them is left out). Scoring covers every text in full. Scores depend
on the text alone.

Defined results: a null or empty text has no features and scores the model's bias; null doc_ids are scored and never
learned from; repeated rows have one row each, and are learned from once; of two labels of an id the greater holds; without labels every score is 0.5; an empty table gives no rows; further
columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 20
MOST_ROWS = 16_384
#: Coordinates that the training task holds, 4 bytes each.
MOST_FEATURES = 1 << 25
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.0
THRESHOLD = 0.3
#: Words at a time, so that a very long text needs no more memory than a long one.
WORDS_AT_ONCE = 1 << 18
_WORDY = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    bias: float
    coordinates: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        full = np.zeros(DIMENSIONS, np.float32)
        full[self.coordinates] = self.weights
        return full


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint32(0x9E3779B1)
    return (h ^ (h >> np.uint32(15))) & np.uint32(DIMENSIONS - 1)


def coordinates(text: bytes | None) -> Iterator[np.ndarray]:
    """Coordinates of a text's features with repeats, some words at a time."""
    words = text.translate(_WORDY).split() if text else []
    for at in range(0, len(words), WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + 2]
        h = np.fromiter(map(crc32, part), np.uint32, len(part))
        one = h[:WORDS_AT_ONCE]
        pair = h[: len(one) + 1]
        pair = pair[:-1] * np.uint32(31) + pair[1:] * np.uint32(0x85EBCA6B)
        skip = h[:-2] * np.uint32(37) + h[2:] * np.uint32(0xC2B2AE35)
        yield _mixed(np.concatenate([one, pair, skip]))


def features(text: bytes | None) -> np.ndarray:
    found = [np.unique(x) for x in coordinates(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over (features, label) rows in the given order."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    bias_z = bias_n = bias = 0.0
    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + root) / ALPHA + L2))
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            new = np.sqrt(nx + g * g)
            z[x] = zx + g - (new - root) / ALPHA * w
            n[x] = nx + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA) if rows else 0.0
    own = np.flatnonzero(w)
    return Model(float(bias), own.astype(np.int32), w[own].astype(np.float32))


def sample(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = MOST_ROWS) -> DataFrame:
    """text, toxic, place of at most `most` labelled rows, those whose ids' hashes are smallest. learn: which ids may be used."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if learn is not None:
        marks = marks.filter(learn)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", F.xxhash64("doc_id"))
    marks = marks.orderBy("place", "doc_id").limit(most)
    marks = marks.select(F.col("doc_id").alias("marked_id"), "toxic", "place")
    texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(marks), F.col("text_id") == F.col("marked_id"))  # at most `most` small rows
    found = found.withColumn("text_place", F.xxhash64("text"))
    # an id may have many rows: first the equal ones go, then what is over the bound, by a sort that keeps `most` rows a task
    kept = found.select("text_id", "text_place", "toxic", "place").distinct().orderBy("place", "text_id", "text_place").limit(most)
    kept = kept.select(F.col("text_id").alias("kept_id"), F.col("text_place").alias("kept_place"))
    same = (F.col("text_id") == F.col("kept_id")) & (F.col("text_place") == F.col("kept_place"))
    return found.join(F.broadcast(kept), same, "left_semi").select("text", "toxic", "place", "text_place")


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = MOST_ROWS, most_features: int = MOST_FEATURES) -> Model:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).tobytes() for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), *batch.columns[1:]], ["x", "toxic", "place", "text_place"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for x, y, place, text_place in zip(*(batch.column(i) for i in range(4))):
                n = len(x.as_py()) // 4
                if (place, text_place) == last or held + n > most_features:
                    continue
                rows.append((np.frombuffer(x.as_py(), np.uint32), y.as_py()))
                held, last = held + n, (place, text_place)
        model = fit(rows)
        at = np.concatenate([[-1], model.coordinates]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([[model.bias], model.weights]).astype(np.float64))], ["at", "weight"])

    rows = sample(docs, labels, learn, most).mapInArrow(read, "x binary, toxic int, place long, text_place long")
    weights = rows.repartition(1).sortWithinPartitions("place", "text_place").mapInArrow(learned, "at int, weight double").collect()
    bias = next((r.weight for r in weights if r.at < 0), 0.0)
    own = sorted((r.at, r.weight) for r in weights if r.at >= 0)
    return Model(bias, np.array([a for a, _ in own], np.int32), np.array([w for _, w in own], np.float32))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    full = model.dense()
    found = np.empty(len(texts))
    for i, text in enumerate(texts.cast(pa.binary())):
        hits = [x[full[x] != 0] for x in coordinates(text.as_py())]
        total = model.bias + (float(full[np.unique(np.concatenate(hits))].sum(dtype=np.float64)) if hits else 0.0)
        found[i] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
    return found


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(shared.value, batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def score_column(model: Model, text: Column, docs: DataFrame) -> Column:
    """The score as a column of docs, for filters that keep all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(scores(shared.value, texts))

    return scored(text)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of an id's text, modulo a number; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of
