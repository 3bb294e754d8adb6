"""The queries of this subpackage, each over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantorium.llm import licenses, mixing, packing, queries_models, secrets, simhash, sql, wavelet
from cantorium.session import spread, table


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spread(table(spark, sf_dir, "documents")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.plan(spread(table(spark, sf_dir, "documents")))
    chosen = chosen.withColumn("first_position", F.round(F.try_element_at("positions", F.lit(1)), 6))
    return chosen.select("doc_id", "size", "source_size", "target", "taken", "first_position").orderBy("first_position", "doc_id")


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(table(spark, sf_dir, "documents")))


def op5_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spread(table(spark, sf_dir, "documents")))
    counts = [secrets.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op7_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = wavelet.read_documents(wavelet.write_shards(spread(table(spark, sf_dir, "documents"))))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_power_of_two_packing": op1_power_of_two_packing,
    "op2_curriculum_mixing": op2_curriculum_mixing,
    "op3_license_digests": op3_license_digests,
    "op5_secret_randomness": op5_secret_randomness,
    "op7_wavelet_token_files": op7_wavelet_token_files,
    "op8_simhash_pigeonring": op8_simhash_pigeonring,
    **queries_models.QUERIES,
}

ORACLES: dict[str, str] = {
    "op2_curriculum_mixing": sql.MIXING,
    "op3_license_digests": sql.LICENSES,
    "op6_flat_graph_dups": sql.VECTOR_DUPLICATES,
    "op10_pivot_topk": sql.TOP_K,
}
