"""Connected components of a graph given as pairs of nodes, by alternating large and small stars.

Each round points every node's neighbours at the smallest node it knows; rounds end when the pairs no longer change,
after a number that grows with the logarithm of a component's width. Pairs are written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantorium.session import materialize


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """a, b with a >= b: each node's larger (large star) or smaller (small star) neighbours tied to its least neighbour."""
    backward = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    sides = pairs.unionByName(backward) if large else pairs
    least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    tied = sides.join(least, "a")
    if large:
        tied = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.filter(F.col("a") != F.col("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """From long columns a, b: node, root (the smallest node of its component), for nodes that are in a pair."""
    a, b = pairs.columns
    pairs = pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") != F.col("b")).distinct()
    pairs = materialize(pairs, "components")
    now = _state(pairs)
    while True:
        pairs = materialize(_star(_star(pairs, True), False), "components")
        was, now = now, _state(pairs)
        if was == now:
            break
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
