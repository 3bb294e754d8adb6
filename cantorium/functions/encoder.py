"""Text encoders behind one interface: a function from a list of texts to rows of numbers, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encode = Callable[[list[str]], np.ndarray]
#: Characters of texts that hashed_ngrams() hashes at a time.
CHARACTERS = 1 << 16


def hashed_ngrams(dimensions: int = 64, n: int = 2) -> Callable[[], Encode]:
    """A repeatable encoder without a model: counts of hashed character n-grams, scaled to length 1."""

    def load() -> Encode:
        def some(texts: list[str]) -> np.ndarray:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
            many = np.maximum(sizes - n + 1, 1)
            owner = np.repeat(np.arange(len(texts)), many)
            at = np.arange(len(owner)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(many) - many), many)
            h = np.zeros(len(owner), np.uint32)
            for k in range(n):
                mixed = (h ^ points[np.minimum(at + k, len(points) - 1)]) * np.uint32(0x9E3779B1)
                h = mixed if sizes.min() > k else np.where(sizes[owner] > k, mixed, h)
            h ^= h >> np.uint32(15)
            signs = np.where(h >> np.uint32(31), 1.0, -1.0)
            return np.bincount(owner * dimensions + h % np.uint32(dimensions), signs, len(texts) * dimensions).reshape(len(texts), dimensions)

        def encode(texts: list[str]) -> np.ndarray:
            rows, begin, held = np.zeros((len(texts), dimensions)), 0, 0
            given = [text or " " for text in texts]
            for end, text in enumerate(given, 1):
                held += len(text)
                if held >= CHARACTERS or end == len(given):
                    rows[begin:end], begin, held = some(given[begin:end]), end, 0
            return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

        return encode

    return load


def encode_column(text: Column, load: Callable[[], Encode]) -> Column:
    """A vector of a text; load runs once in each worker, so it may open model weights there."""

    @F.pandas_udf("array<float>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series(list(encode(texts.fillna("").tolist()).astype(np.float32)))

    return encoded(text)


def cached(df: DataFrame, key: str, text: str, load: Callable[[], Encode], path: str, fingerprint: str) -> DataFrame:
    """Vectors from a parquet cache; texts whose fingerprint (encoder name and text hash) is not in it are encoded and added."""
    spark = df.sparkSession
    marked = df.select(key, F.col(text).alias("text"), F.md5(F.concat_ws("|", F.lit(fingerprint), F.col(text))).alias("fingerprint"))
    try:
        known = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001  Spark has one class for all analysis errors
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = spark.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, fingerprint string, embedding array<float>")
    new = marked.join(known.select("fingerprint"), "fingerprint", "left_anti")
    new.select(key, "fingerprint", encode_column(F.col("text"), load).alias("embedding")).write.mode("append").parquet(path)
    vectors = spark.read.parquet(path).select("fingerprint", "embedding").dropDuplicates(["fingerprint"])
    return marked.join(vectors, "fingerprint").select(key, "embedding")
