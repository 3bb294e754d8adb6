"""Roll-ups of scores and issues, conditions compared, ranks and deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantorium.functions import stats
from cantorium.operators.quantiles import ordered_sums
from cantorium.session import bounded


def roll_up(df: DataFrame, score: Column, issue: Column, sets: list[list[str]], kinds: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """Score statistics and issue rates for each grouping set in one pass; a group column that is rolled up is null.

    kinds: issue kinds whose rate is wanted as {kind}_ratio. least: groups of fewer rows are left out.
    """
    dims = list(dict.fromkeys(d for s in sets for d in s))
    s = F.coalesce(score, F.lit(0.0))
    base = df.select(*dims, s.alias("s"), issue.alias("issue"))
    ratio = lambda condition: F.avg(condition.cast("double"))
    v = F.col("s")
    measures = [
        F.count(F.lit(1)).alias("total"),
        F.avg("s").alias("avg_score"),
        *[F.percentile("s", F.lit(p / 100)).alias(f"p{p}_score") for p in (25, 50, 75)],
        ratio(v >= 99.999).alias("perfect_ratio"),
        ratio((v >= 80) & (v < 99.999)).alias("high_ratio"),
        ratio((v >= 60) & (v < 80)).alias("mid_ratio"),
        ratio((v > 0) & (v < 60)).alias("low_ratio"),
        ratio(v == 0).alias("zero_ratio"),
        ratio(F.col("issue").isNull()).alias("issue_free_ratio"),
        *[ratio(F.coalesce(F.col("issue") == kind, F.lit(False))).alias(f"{kind}_ratio") for kind in kinds],
    ]
    return base.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims]).agg(*measures).filter(F.col("total") >= least)


def issue_breakdown(df: DataFrame, groups: list[str], key: str, issue: str, kinds: DataFrame) -> DataFrame:
    """For every group and every kind of issue (column of kinds, a few rows) the rows with it and the issues, zero-filled."""
    counted = df.groupBy(*groups, issue).agg(F.count(F.lit(1)).alias("issues"), F.countDistinct(key).alias("rows_with_issue"))
    every = df.select(*groups).distinct().crossJoin(bounded(kinds, "the list of kinds"))
    return every.join(counted, [*groups, issue], "left").na.fill(0, ["issues", "rows_with_issue"]).select(*groups, issue, "rows_with_issue", "issues")


def score_histogram(df: DataFrame, groups: list[str], score: Column) -> DataFrame:
    """Rows of each group in each of the five score buckets, zero-filled."""
    bucket = stats.score_bucket(score)
    sums = df.groupBy(*groups).agg(*[F.sum((bucket == b).cast("long")).alias(f"b{i}") for i, b in enumerate(stats.BUCKETS)])
    stacked = ", ".join(f"'{b}', b{i}" for i, b in enumerate(stats.BUCKETS))
    return sums.select(*groups, F.expr(f"stack({len(stats.BUCKETS)}, {stacked}) as (bucket, n)"))


def common_messages(df: DataFrame, groups: list[str], message: str, k: int = 15) -> DataFrame:
    """Each group's k most common messages with their kind."""
    counts = df.groupBy(*groups, message).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), message))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("kind", stats.issue_type(F.col(message)))


def weighted_means(df: DataFrame, groups: list[str], weight: str, values: list[str]) -> DataFrame:
    """A17."""
    return df.groupBy(*groups).agg(F.sum(weight).alias("weight"), *[(F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(v) for v in values])


def condition_deltas(summary: DataFrame, specs: DataFrame, condition: str, keys: list[str], values: list[str]) -> DataFrame:
    """For each (from, to) of specs the change of every value between the two conditions, by keys."""
    left = summary.select(F.col(condition).alias("from"), *keys, *[F.col(v).alias(f"{v}_from") for v in values])
    right = summary.select(F.col(condition).alias("to"), *keys, *[F.col(v).alias(f"{v}_to") for v in values])
    joined = bounded(specs, "the list of condition pairs").join(left, "from").join(right, ["to", *keys])
    return joined.select("from", "to", *keys, *[(F.col(f"{v}_to") - F.col(f"{v}_from")).alias(f"{v}_delta") for v in values])


def prefer(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], names: tuple[str, str] = ("strict", "observe")) -> DataFrame:
    """The left row where there is one, else the right one, with its provenance."""
    tag = lambda df, side: df.select(*keys, *[F.col(v).alias(f"{side}_{v}") for v in values], F.lit(True).alias(f"in_{side}"))
    both = tag(left, "l").join(tag(right, "r"), keys, "full")
    pick = [F.when(F.col("in_l"), F.col(f"l_{v}")).otherwise(F.col(f"r_{v}")).alias(v) for v in values]
    return both.select(*keys, *pick, F.when(F.col("in_l"), names[0]).otherwise(names[1]).alias("provenance"))


def ranks_and_deviations(df: DataFrame, group: str, name: str, values: list[str]) -> DataFrame:
    """For every value the rank in its group (descending, then name) and the deviation from the group's mean; top name by the first value."""
    own = Window.partitionBy(group)
    columns = {}
    for v in values:
        columns[f"{v}_rank"] = F.row_number().over(own.orderBy(F.desc(v), name))
        columns[f"{v}_deviation"] = F.col(v) - F.avg(v).over(own)
    return df.withColumns(columns).withColumn("top_name", F.first(name).over(own.orderBy(F.desc(values[0]), name)))


def best_and_worst(df: DataFrame, name: str, condition: str, value: str) -> DataFrame:
    """Each name's best and worst condition, the mean, and all conditions in order."""
    pair = F.struct(F.col(value).alias("v"), F.col(condition).alias("c"))
    return df.groupBy(name).agg(
        F.max(pair)["c"].alias("best"), F.min(pair)["c"].alias("worst"), F.max(value).alias("best_value"), F.min(value).alias("worst_value"),
        F.avg(value).alias("average"), F.array_join(F.sort_array(F.collect_list(F.col(condition).cast("string"))), "|").alias("conditions"),
    )


def contrast_summary(df: DataFrame, groups: list[str], axes: tuple[str, str, str]) -> DataFrame:
    """Mean deltas of a contrast group, the peak by size of the first axis, and the dominant axis of the means."""
    means = [F.avg(a).alias(f"mean_{a}") for a in axes]
    peak = F.max_by(axes[0], F.struct(F.abs(axes[0]), axes[0])).alias("peak")
    out = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *means, peak)
    columns = [F.col(f"mean_{a}") for a in axes]
    return out.withColumns({"dominant": stats.dominant_axis(*columns), "dominant_by_size": stats.dominant_axis(*columns, by_size=True)})


def longest_run(df: DataFrame, groups: list[str], order: str, value: str) -> DataFrame:
    """The longest run of one non-empty value in order, 0 without any (gaps and islands)."""
    own = Window.partitionBy(*groups).orderBy(order)
    v = F.coalesce(F.col(value).cast("string"), F.lit(""))
    placed = df.select(*groups, order, v.alias("v")).withColumn("change", F.when(F.lag("v").over(own) == F.col("v"), 0).otherwise(1))
    islands = placed.withColumn("island", F.sum("change").over(own)).groupBy(*groups, "island", "v").agg(F.count(F.lit(1)).alias("n"))
    return islands.groupBy(*groups).agg(F.max(F.when(F.col("v") != "", F.col("n")).otherwise(0)).alias("longest_run"))


def percentile_rank(values: DataFrame, base: DataFrame, groups: list[str], key: str, value: str) -> DataFrame:
    """Share of the group's base values that are at most the value; null without a base.

    Values and base are counted together in range partitions, so no group is gathered in one task.
    """
    known = base.select(*groups, value, F.lit(1).cast("long").alias("n"))
    asked = values.select(*groups, value, F.lit(0).cast("long").alias("n"))
    ranked = ordered_sums(known.unionByName(asked).filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.sum("n").alias("n")), groups, value)
    ranked = ranked.select(*groups, value, F.when(F.col("total") > 0, (F.col("below") + F.col("n")) / F.col("total")).alias("percentile_rank"))
    return values.select(*groups, key, value).join(ranked, [*groups, value], "left")


def matrix(df: DataFrame, row: str, column: str, names: list[str], value: str) -> DataFrame:
    """Rows by columns, rounded to 3 digits, 0 where there is nothing."""
    wide = df.groupBy(row).pivot(column, names).agg(F.round(F.first(value), 3))
    return wide.na.fill(0.0, names)
