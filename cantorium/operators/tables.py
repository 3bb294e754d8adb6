"""Set operations on rows and keyed changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantorium.functions.text import merged_characters


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left beyond their count in right, with how many are missing."""
    keys = left.columns
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys, "left")
    missing = F.col("n") - F.coalesce("m", F.lit(0))
    return counts.filter(missing > 0).select(*keys, missing.alias("missing"))


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys right does not have."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def update_by_key(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with columns replaced where a change has the key; of several changes the greatest, compared column by column, wins as a whole."""
    new = changes.groupBy(key).agg(F.max(F.struct(*columns)).alias("__change"))
    joined = table.join(new, key, "left")
    replaced = {c: F.when(F.col("__change").isNotNull(), F.col("__change").getField(c)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(replaced).select(*table.columns)


def merge_dictionaries(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """The union of keys with the distinct Han characters of both sides in order."""
    a, b = left.select(key, F.col(text).alias("__a")), right.select(key, F.col(text).alias("__b"))
    return a.join(b, key, "full").select(key, merged_characters(F.col("__a"), F.col("__b")).alias(text))


def by_id_or_position(items: DataFrame, results: DataFrame, batch: str) -> DataFrame:
    """Each item (batch, pos from 0) with the result whose id is pos + 1, else the one at its position."""
    named = results.select(batch, (F.col("id") - 1).alias("pos"), F.col("value").alias("by_id")).filter(F.col("pos").isNotNull())
    placed = results.select(batch, F.col("at").alias("pos"), F.col("value").alias("by_pos"))
    named = named.groupBy(batch, "pos").agg(F.min("by_id").alias("by_id"))
    return items.join(named, [batch, "pos"], "left").join(placed, [batch, "pos"], "left").select(*items.columns, F.coalesce("by_id", "by_pos").alias("value"))
