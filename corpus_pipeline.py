"""A corpus pipeline: each stage works on what its predecessor kept, and is written and read again in between.

toxicity drops documents that the classifier rejects; it learns from a bounded sample of the labelled rows (at most
toxicity.MOST_ROWS) and scores every text. near_duplicates keeps one document of each class of fingerprints; secrets
replaces every found span by a mark; mixing repeats and orders the documents by the curriculum; packing cuts them into
power-of-two sequences.

Defined results of all stages: an empty table gives an empty table; columns beside doc_id and text are kept as they are,
whatever their names (but for n_chars, which follows the text). toxicity scores null and empty texts like texts without
features. near_duplicates keeps every row without a doc_id, and counts null and empty texts as copies of each other. secrets
leaves null texts null. mixing places documents without words like others, though they add none. packing makes a null or empty text the end id alone.
Repeated rows stay repeated except in near_duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantorium.llm import mixing, packing, secrets, simhash, toxicity
from cantorium.session import materialize, spread, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold; all of them where nothing could be learned."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not len(model.coordinates) and model.bias == 0:  # nothing was learned, so nothing is rejected
        return docs
    text = F.col("text").cast("string")
    return docs.filter(toxicity.score_column(model, text, docs) < toxicity.THRESHOLD)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class."""
    return simhash.drop_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets marked out."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each up to three times."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Neither the classifier nor the tokenizer can be put in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
