"""Corpus analytics on Spark: DataFrame-first operators for texts, scores and vectors."""
