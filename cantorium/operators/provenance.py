"""Where texts may come from: baselines of nearest scores, percentile ranks with fallback, source profiles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantorium.functions import stats

OVERALL = "__overall__"


def baseline(nearest: DataFrame, group: str, bucket: str, value: str) -> DataFrame:
    """Count, mean, percentiles and max of nearest scores by (group, bucket), by bucket, and over all, in one pass."""
    rows = nearest.select(F.col(group).cast("string").alias(group), F.col(bucket).cast("string").alias(bucket), value)
    g, b = F.col(group), F.col(bucket)
    found = rows.groupingSets([[g, b], [b], []], g, b).agg(*stats.summary(F.col(value)))
    return found.withColumns({group: F.coalesce(group, F.lit(OVERALL)), bucket: F.coalesce(bucket, F.lit(OVERALL))})


def with_fallback(df: DataFrame, base: DataFrame, group: str, bucket: str, columns: list[str]) -> DataFrame:
    """Base columns by (group, bucket), else (overall, bucket), else (overall, overall)."""
    named = lambda level: [F.col(c).alias(f"__{level}_{c}") for c in columns]
    exact = base.filter((F.col(group) != OVERALL) & (F.col(bucket) != OVERALL)).select(group, bucket, *named(0))
    by_bucket = base.filter((F.col(group) == OVERALL) & (F.col(bucket) != OVERALL)).select(bucket, *named(1))
    overall = base.filter((F.col(group) == OVERALL) & (F.col(bucket) == OVERALL)).select(*named(2))
    joined = df.join(exact, [group, bucket], "left").join(by_bucket, bucket, "left").crossJoin(F.broadcast(overall))  # one row
    return joined.select(*df.columns, *[F.coalesce(f"__0_{c}", f"__1_{c}", f"__2_{c}").alias(c) for c in columns])


def _channel(parts: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """One channel of profile(): from {name}_source and {name}_score of each part."""
    own = Window.partitionBy(key).orderBy(order)
    marked = parts.select(key, order, F.col(f"{name}_source").alias("s"), F.col(f"{name}_score").alias("score"))
    marked = marked.withColumn("new", F.when(F.lag("s").over(own).eqNullSafe(F.col("s")), 0).otherwise(1)).withColumn("island", F.sum("new").over(own))
    runs = marked.groupBy(key, "island", "s").agg(F.count(F.lit(1)).alias("run"), F.max("score").alias("score"), F.sum("score").alias("sum"))
    sources = runs.groupBy(key, "s").agg(F.sum("run").alias("n"), F.max("run").alias("run"), F.max("score").alias("score"), F.sum("sum").alias("sum"))
    real = F.col("s").isNotNull()
    found = sources.groupBy(key).agg(
        F.sum("n").alias("parts"),
        F.count("s").alias("distinct"),
        F.max(F.when(real, F.col("run")).otherwise(0)).alias("run"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("best"),
        F.coalesce(F.sum("sum"), F.lit(0.0)).alias("sum"),
        F.min(F.when(real, F.struct((-F.col("n")).alias("n"), F.col("s").alias("s")))).alias("top"),
    )
    return found.select(
        key, F.col("top.s").alias(f"{name}_dominant_source"), F.coalesce(-F.col("top.n") / F.col("parts"), F.lit(0.0)).alias(f"{name}_dominant_coverage"),
        F.col("distinct").alias(f"distinct_{name}_sources"), F.col("run").alias(f"longest_{name}_run"), F.col("best").alias(f"max_sentence_{name}_score"),
        (F.col("sum") / F.col("parts")).alias(f"mean_sentence_{name}_score"),
    )


def profile(parts: DataFrame, key: str, order: str, channels: tuple[str, ...] = ("sem", "lex")) -> DataFrame:
    """A row for each text from its parts in order: how many, how many have one source in all channels, and of each channel the dominant source (most
    parts, then smallest id) with its share, the number of sources, the longest run of one source, the best and the mean score. parts: {channel}_source and {channel}_score."""
    first = F.col(f"{channels[0]}_source")
    agree = F.lit(True)
    for name in channels[1:]:
        agree = agree & (F.col(f"{name}_source") == first)
    found = parts.groupBy(key).agg(F.count(F.lit(1)).alias("sentence_count"), F.sum(F.coalesce(agree & first.isNotNull(), F.lit(False)).cast("long")).alias("same_source_sentence_count"))
    for name in channels:
        found = found.join(_channel(parts, key, order, name), key)
    return found


def attribute(profiles: DataFrame, sources: DataFrame, source: str, names: list[str]) -> DataFrame:
    """Profiles with attributes of a source (columns `names` of sources, by source_id), as {source}_{name}; null where the source is unknown."""
    known = sources.select(F.col("source_id").alias(source), *[F.col(n).alias(f"{source}_{n}") for n in names])
    return profiles.join(known, source, "left")


def report(profiles: DataFrame, group: str, percentile: str, source: str, score: str, n_sources: int = 5) -> DataFrame:
    """Per group the rows, tail shares (at 0.95, 0.99 and exact matches), mean score and the top sources as JSON."""
    share = lambda condition: F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
    tails = profiles.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), share(F.col(percentile) >= 0.95).alias("tail_95"), share(F.col(percentile) >= 0.99).alias("tail_99"),
        share(F.col(score) >= 0.999999).alias("exact"), F.avg(score).alias("mean_score"),
    )
    counts = profiles.filter(F.col(source).isNotNull()).groupBy(group, source).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), source)
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n_sources)
    listed = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("r", F.col(source).cast("string").alias("source"), "n"))).alias("items"))
    listed = listed.select(group, F.to_json(F.transform("items", lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n")))).alias("top_sources"))
    return tails.join(listed, group, "left")
