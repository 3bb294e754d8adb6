"""Descriptive statistics of groups: value counts, concentration, token coverage, lift, overlap of vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantorium.functions import stats
from cantorium.functions.text import ranked_string
from cantorium.session import materialize


def value_counts(df: DataFrame, groups: list[str], item: str) -> DataFrame:
    """N, share of the group and rank (n descending, then item) of each value."""
    counts = df.groupBy(*groups, item).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*groups) if groups else Window.partitionBy()
    ranked = counts.withColumns({"share": F.col("n") / F.sum("n").over(own), "rank": F.row_number().over(own.orderBy(F.desc("n"), item))})
    return ranked.select(*groups, item, "n", "share", "rank")


def ranked_counts(counts: DataFrame, groups: list[str], item: str, k: int) -> DataFrame:
    """The k greatest counts of each group with rank (n descending, then item); each task hands on k rows a group at most."""
    order = Window.partitionBy(*groups).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def likely(counts: DataFrame, groups: list[str], k: int) -> DataFrame:
    """The counts that reach their group's k-th greatest, found from how many items have which n, so that only these need an order. Reads counts twice."""
    each = counts.groupBy(*groups, "n").agg(F.count(F.lit(1)).alias("items"))
    order = Window.partitionBy(*groups).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    reach = each.withColumn("before", F.coalesce(F.sum("items").over(order), F.lit(0))).filter(F.col("before") < k).groupBy(*groups).agg(F.min("n").alias("least"))
    reach = materialize(reach, "least-counts")  # its size is known then, and counts stay where they are if it is small
    return (counts.join(reach, groups) if groups else counts.crossJoin(F.broadcast(reach))).filter(F.col("n") >= F.col("least")).select(*counts.columns)  # without groups one row


def top_string(counts: DataFrame, groups: list[str], item: str, k: int, name: str) -> DataFrame:
    """The k most frequent values of each group as item:n|item:n, ties by item."""
    kept = ranked_counts(counts.select(*groups, item, "n"), groups, item, k)
    listed = kept.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), F.col(item).alias("name"), "n"))).alias("items"))
    return listed.select(*groups, ranked_string(F.col("items")).alias(name))


def concentration(counts: DataFrame, groups: list[str], item: str, k: int) -> DataFrame:
    """Entropy, normalised entropy, Herfindahl index and share of the k most frequent values."""
    sums = counts.groupBy(*groups).agg(
        F.sum("n").alias("total"),
        F.count("n").alias("distinct_values"),
        stats.entropy_bits(F.col("n")).alias("entropy"),
        stats.normalized_entropy(F.col("n")).alias("normalized_entropy"),
        stats.herfindahl(F.col("n")).alias("hhi"),
    )
    top = ranked_counts(counts.select(*groups, item, "n"), groups, item, k).groupBy(*groups).agg(F.sum("n").alias("top_n"))
    keyed = [F.col(g).alias(f"__{g}") for g in groups]
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return sums.join(top.select(*keyed, "top_n"), same).select(*sums.columns, (F.col("top_n") / F.col("total")).alias("topk_share"))


def explode_tokens(df: DataFrame, groups: list[str], key: str, tokens: Column) -> DataFrame:
    return df.select(*groups, key, F.explode(tokens).alias("token"))


def token_coverage(df: DataFrame, groups: list[str], tokens: Column) -> DataFrame:
    """N and documents (rows) of each token in each group, for rows that are a document each.

    A row hands on its tokens and, once each, its different tokens; both are summed by task first, so what is shuffled
    grows with the vocabulary and not with the corpus. Texts are split once, and lists are unpacked whole, without a step for each token.
    """
    split = df.select(*groups, tokens.alias("__tokens"))
    lists = F.array(F.struct(F.col("__tokens").alias("list"), F.lit(0).cast("long").alias("first")), F.struct(F.array_distinct("__tokens").alias("list"), F.lit(1).cast("long").alias("first")))
    rows = split.select(*groups, F.inline(lists)).select(*groups, "first", F.explode("list").alias("token"))
    return rows.groupBy(*groups, "token").agg(F.sum(1 - F.col("first")).alias("n"), F.sum("first").alias("docs"))


def widened(coverage: DataFrame, groups: list[str]) -> DataFrame:
    """token_coverage() of a wider scope, from that of groups that share no document."""
    return coverage.groupBy(*groups, "token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def top_tokens(coverage: DataFrame, sizes: DataFrame, groups: list[str], k: int) -> DataFrame:
    """The k most frequent tokens of each group with share of tokens, share of documents and rank. sizes: group_docs by group."""
    totals = coverage.groupBy(*groups).agg(F.sum("n").alias("all_n"))
    kept = ranked_counts(likely(coverage.select(*groups, "token", "n", "docs"), groups, k), groups, "token", k)
    found = kept.join(totals, groups).join(sizes, groups) if groups else kept.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(sizes))  # one row each
    return found.select(*groups, "token", "n", "docs", (F.col("n") / F.col("all_n")).alias("share"), (F.col("docs") / F.col("group_docs")).alias("coverage"), "rank")


def lift(group: DataFrame, scope: DataFrame, group_sizes: DataFrame, scope_docs: DataFrame, groups: list[str], k: int) -> DataFrame:
    """Each group's k signature tokens, by coverage in the group over coverage in the scope."""
    scoped = scope.select("token", F.col("docs").alias("scope_hits"))
    both = group.join(scoped, "token").join(group_sizes, groups).crossJoin(F.broadcast(scope_docs))  # one row: the scope's size
    both = both.withColumn("group_coverage", F.col("docs") / F.col("group_docs")).withColumn("scope_coverage", F.col("scope_hits") / F.col("scope_docs"))
    both = both.withColumn("lift", F.col("group_coverage") / F.col("scope_coverage"))
    order = Window.partitionBy(*groups).orderBy(F.desc(F.round("lift", 9)), F.desc("docs"), F.desc("n"), "token")
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(*groups, "token", "n", "docs", "group_coverage", "scope_coverage", "lift", "rank")


def vocabulary_overlap(coverage: DataFrame, group: str, k: int) -> DataFrame:
    """For every pair of groups the sizes of intersection, union and Jaccard of their vocabularies, also of their k most frequent tokens."""
    counts = coverage.select(group, "token", "n").filter(F.col(group).isNotNull())
    top = materialize(ranked_counts(likely(counts, [group], k), [group], "token", k).select(group, "token", F.lit(True).alias("top")), "top-tokens")
    words = counts.select(group, "token").join(top, [group, "token"], "left").select("token", F.struct(F.col(group).alias("g"), F.coalesce("top", F.lit(False)).alias("top")).alias("one"))
    held = words.groupBy("token").agg(F.sort_array(F.collect_list("one")).alias("held")).groupBy("held").agg(F.count(F.lit(1)).alias("n"))
    held = materialize(held, "token-groups")  # tokens of the same groups count together
    ones = held.select("n", "held", F.explode("held").alias("x"))
    sizes = ones.groupBy(F.col("x.g").alias(group)).agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("x.top").cast("long")).alias("top_size"))
    both = ones.select("n", "x", F.explode("held").alias("y")).filter(F.col("x.g") < F.col("y.g"))
    shared = both.groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b")).agg(F.sum("n").alias("common"), F.sum(F.col("n") * (F.col("x.top") & F.col("y.top")).cast("long")).alias("top_common"))
    left, right = (sizes.select(F.col(group).alias(x), F.col("size").alias(f"size_{x}"), F.col("top_size").alias(f"top_{x}")) for x in "ab")
    pairs = left.join(right, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").na.fill(0, ["common", "top_common"])
    union, top_union = F.col("size_a") + F.col("size_b") - F.col("common"), F.col("top_a") + F.col("top_b") - F.col("top_common")
    return pairs.select("a", "b", "common", union.alias("union_size"), (F.col("common") / union).alias("jaccard"), "top_common", (F.col("top_common") / top_union).alias("top_jaccard"))
