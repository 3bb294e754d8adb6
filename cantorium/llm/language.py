"""Language identification by multinomial naive Bayes over hashed character n-grams.

The n-grams of one to three characters of the lower-cased text are hashed to a fixed number of features. Counts by
language, smoothed, give a matrix of log-probabilities that is sent to every task; a text's score for a language is the
sum of its features' entries plus the language's log share, over all rows with a language. Counts come from a bounded
sample that is drawn language by language (about MOST_ROWS / languages rows each, and all rows of a language that has no
more), by hashes of ids, so that rare languages stay. Every text is scored in full: a batch of texts is a sparse matrix of
feature counts, whose entries are multiplied by the rows of the matrix and summed text by text.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if no row has a language;
null doc_ids are scored and never learned from; repeated rows have one row each; an empty table gives no rows; ties go
to the first language in code point order; more than MOST_LANGUAGES different languages are an error, as the matrix grows
with them; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE_BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MOST_ROWS = 20_000
#: Languages that a model takes; its matrix then has 128 MB.
MOST_LANGUAGES = 512
#: Characters of a batch, and of a very long text, that are scored at a time.
CHARACTERS_AT_ONCE = 1 << 20
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray
    log_p: np.ndarray  # features x languages


def _features(text: str) -> Iterator[np.ndarray]:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    longest = max(ORDERS)
    for at in range(0, len(points), CHARACTERS_AT_ONCE):
        part = points[at : at + CHARACTERS_AT_ONCE + longest - 1]
        h = np.zeros(len(part), np.uint32)
        found = []
        for order in range(1, longest + 1):
            if len(part) < order:
                break
            h = h[: len(part) - order + 1] * np.uint32(0x01000193) + part[order - 1 :] + np.uint32(order)
            if order in ORDERS:
                mixed = h[:CHARACTERS_AT_ONCE] * np.uint32(0x9E3779B1)
                found.append((mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - FEATURE_BITS))
        yield np.concatenate(found)


def train(docs: DataFrame, learn: Column | None = None, most: int = MOST_ROWS) -> Model:
    """learn: which rows of docs may be used."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        known = known.filter(learn)
    shares = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different languages")
    each = max(1, most // max(1, len(shares)))
    often = {lang: each / n for lang, n in shares.items() if n > each}
    if often:
        steps = 1 << 30
        part = F.try_element_at(F.create_map(*[F.lit(v) for lang, share in sorted(often.items()) for v in (lang, int(steps * share))]), F.col("lang"))
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < F.coalesce(part, F.lit(steps)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                own = sums.setdefault(lang, np.zeros(1 << FEATURE_BITS, np.int64))
                for x in _features(text.as_py() or ""):
                    own += np.bincount(x, minlength=1 << FEATURE_BITS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "feature", "n"])

    counts = known.select("text", "lang").mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most languages x features rows
    names = tuple(sorted(shares))
    place = {name: k for k, name in enumerate(names)}
    full, rows = np.full((1 << FEATURE_BITS, len(names)), SMOOTHING), np.array([shares[name] for name in names], float)
    column = np.array([place[x] for x in table["lang"].to_pylist()], int)
    full[table["feature"].to_numpy(), column] += table["n"].to_numpy()
    log_p = np.log(full / full.sum(0)) if names else full
    return Model(names, np.log(rows / rows.sum()) if names else rows, log_p.astype(np.float32))


def posteriors(texts: list[str], model: Model) -> np.ndarray:
    """Log-probabilities (texts x languages) of a batch, from the sparse counts of its features."""
    total = np.repeat(model.prior[None], len(texts), axis=0)
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        if not held:
            return
        # keys of (text, feature) with their counts: the batch's sparse matrix, by text
        keys = np.concatenate([x.astype(np.int64) + (r << FEATURE_BITS) for r, x in held])
        keys, n = np.unique(keys, return_counts=True)
        row, feature = keys >> FEATURE_BITS, keys & ((1 << FEATURE_BITS) - 1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        parts = model.log_p[feature] * n[:, None]
        np.add.at(total, row[first], np.add.reduceat(parts, first, axis=0, dtype=np.float64))
        held.clear()

    size = 0
    for r, text in enumerate(texts):
        for x in _features(text):
            held.append((r, x))
            size += len(x)
            if size >= CHARACTERS_AT_ONCE:
                add()
                size = 0
    add()
    return total


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the prediction) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            able = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
            names, sure = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if able:
                total = posteriors([texts[i] for i in able], model)
                best = total.argmax(1)
                names[able] = np.array(model.languages, object)[best]
                sure[able] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
