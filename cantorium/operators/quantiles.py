"""Exact ranks and percentiles of groups of any size: values are counted, range-partitioned, and summed part by part.

No group is gathered: a task holds a range of different values, and only sums by group and part, at most one row for each
part and one more for each group, are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantorium.session import materialize


def ordered_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, value, n (rows with the value), below (rows with a smaller value), total; null values are left out."""
    return ordered_sums(df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")), groups, value)


def ordered_sums(counts: DataFrame, groups: list[str], value: str) -> DataFrame:
    """ordered_counts() from counts: a row with n for each group and value."""
    ranged = materialize(counts.repartitionByRange(*groups, value).withColumn("part", F.spark_partition_id()), "ordered-counts")
    own = Window.partitionBy(*groups)
    sums = ranged.groupBy(*groups, "part").agg(F.sum("n").alias("in_part"))
    sums = sums.withColumns({"before": F.coalesce(F.sum("in_part").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("in_part").over(own)})
    sums = sums.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("part").alias("__part"), "before", "total")
    same = F.col("part") == F.col("__part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    within = Window.partitionBy(*groups, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, same)
    return placed.select(*groups, value, "n", (F.col("before") + F.col("within")).alias("below"), "total")


def floor_percentiles(df: DataFrame, groups: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """A5: for each name the element at floor(p/100 * (n - 1)) of the group's sorted values."""
    ordered = ordered_counts(df, groups, value)
    found = {}
    for name, p in points.items():
        at = F.floor(F.lit(p / 100) * (F.col("total") - 1))
        found[name] = F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("n")), F.col(value))).alias(name)
    return ordered.groupBy(*groups).agg(*found.values())


def percentiles(df: DataFrame, groups: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """A4: for each name the percentile with linear interpolation between the two elements next to p/100 * (n - 1)."""
    ordered = ordered_counts(df, groups, value)
    found = []
    for name, p in points.items():
        place = F.lit(p / 100) * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
        a, b = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
        share = F.max(place - low)
        found.append((a + (b - a) * share).alias(name))
    return ordered.groupBy(*groups).agg(*found)


def cumulative_share(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Groups, value and the share of the group's values that are at most it, a row for each different value."""
    return ordered_counts(df, groups, value).select(*groups, value, ((F.col("below") + F.col("n")) / F.col("total")).alias("share"))
