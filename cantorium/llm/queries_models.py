"""Queries of the classifiers and of the vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantorium.llm import embed_dups, language, topk, toxicity
from cantorium.session import spread, table


def op4_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    held = F.coalesce(toxicity.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = toxicity.train(docs, labels, ~held)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_flat_graph_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    held = F.coalesce(toxicity.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    found = language.predict(docs, language.train(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op4_ftrl_toxicity": op4_ftrl_toxicity,
    "op6_flat_graph_dups": op6_flat_graph_dups,
    "op9_bayes_language": op9_bayes_language,
    "op10_pivot_topk": op10_pivot_topk,
}
