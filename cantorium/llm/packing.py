"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces of the context length and, for the rest, one piece for each set bit of its
length, longest first. A piece is a sequence of its own: its length is a power of two, so it needs no padding, and no
sequence crosses documents. Pieces of equal length form a bucket; write_buckets() lays a table of pieces out with a folder
for each bucket, so that a reader of one shape reads no other. Cutting and writing need no shuffle: documents are
tokenised where they are read, and a task writes its pieces bucket by bucket.

Defined results: a null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed each on
its own; an empty table gives no pieces; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantorium.llm.tokens import END, encoder

MAX_TOKENS = 2048
#: Bytes of ids after which a batch is handed on.
BATCH_BYTES = 8 << 20
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


def cuts(n: int, longest: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """Start and length of each piece of n ids."""
    pieces = [(at, longest) for at in range(0, n - longest + 1, longest)]
    at = len(pieces) * longest
    for bit in range(longest.bit_length() - 2, -1, -1):
        if (n - at) >> bit:
            pieces.append((at, 1 << bit))
            at += 1 << bit
    return pieces


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, length, ids, total = zip(*rows)
    i64 = pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, i64), pa.array(start, i64), pa.array(length, i64), pa.array(ids, pa.binary()), pa.array(total, i64)],
        ["doc_id", "start", "length", "ids", "doc_tokens"],
    )


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset.

    sequence_id holds the bucket (log2 of the length) in its highest bits, so that ids of a bucket are adjacent.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                ids = encode(text.as_py()) + END
                total = len(ids) // 4
                rows += [(doc, at, n, ids[4 * at : 4 * (at + n)], total) for at, n in cuts(total, max_tokens)]
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)
    bucket = F.bit_count(F.col("length") - 1)
    return pieces.select(
        "*",
        bucket.alias("bucket"),
        F.shiftleft(bucket.cast("long"), 55).bitwiseOR(F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """Write pieces under path, a folder for each bucket, and read them back; a filter on bucket reads its folder alone."""
    pieces.write.partitionBy("bucket").parquet(path)
    schema = [f for f in pieces.schema.fields if f.name != "bucket"] + [pieces.schema["bucket"]]
    return pieces.sparkSession.read.schema(T.StructType(schema)).parquet(path)


def tokens(piece_ids: bytes) -> np.ndarray:
    """The ids of a piece as numbers."""
    return np.frombuffer(piece_ids, "<u4")
