"""How alike the texts of a group are: repeatable samples, pair metrics, composite scores, averages and a human baseline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantorium.functions import stats
from cantorium.functions.lexical import ratio, seq_ratio, set_similarity
from cantorium.operators import pairs


def sample(df: DataFrame, groups: list[str], key: str, sizes: DataFrame | int, seed: int = 42, rounds: int = 1) -> DataFrame:
    """Per round a sample of each group without replacement, ordered by md5 of seed, group, round and id; all rows of smaller groups."""
    rows = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(g).cast("string") for g in groups], F.col("round").cast("string"), F.col(key).cast("string")))
    rows = rows.withColumn("__order", order)
    place = F.row_number().over(Window.partitionBy(*groups, "round").orderBy("__order", key))
    if isinstance(sizes, int):
        return rows.withColumn("__place", place).filter(F.col("__place") <= sizes).drop("__place", "__order")
    return rows.withColumn("__place", place).join(sizes, [c for c in sizes.columns if c != "target"]).filter(F.col("__place") <= F.col("target")).drop("__place", "__order", "target")


def target_sizes(df: DataFrame, model: str, tune: str, least_model: int = 30, least_tune: int = 8, most: int = 20) -> DataFrame:
    """For each tune the least count over the models that have enough rows and enough of the tune, capped."""
    counts = df.groupBy(model, tune).agg(F.count(F.lit(1)).alias("n"))
    able = counts.withColumn("all", F.sum("n").over(Window.partitionBy(model))).filter((F.col("all") >= least_model) & (F.col("n") >= least_tune))
    return able.groupBy(tune).agg(F.least(F.min("n"), F.lit(most)).alias("target"))


def free_target_sizes(df: DataFrame, tune: str, least_tune: int = 8, most: int = 20) -> DataFrame:
    """Each tune's count, if it is enough, capped."""
    return df.groupBy(tune).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_tune).select(tune, F.least("n", F.lit(most)).alias("target"))


def whole_metrics(df: DataFrame, groups: list[str], key: str, vector: str, text: str | None = None, high: float = 0.85) -> DataFrame:
    """Per group the median, p90 and high share of the pairs' cosines, and with a text column the share of pairs nearer in meaning than in wording."""
    if text is None:  # groups of any size
        cuts = pairs.cosine_cuts(df, groups, key, vector, [50, 90], high)
        return cuts.withColumnsRenamed({"p0": "whole_sem_p50", "p1": "whole_sem_p90", "share": "whole_highsim_ratio"})
    found = pairs.within(df, groups, key, [vector, *([text] if text else [])])
    sem = stats.cosine(F.col(f"{vector}_a"), F.col(f"{vector}_b"))
    found = found.select(*groups, sem.alias("sem"), *([seq_ratio(f"{text}_a", f"{text}_b").alias("lex")] if text else []))
    measures = [
        F.count(F.lit(1)).alias("pairs"),
        stats.percentile(F.col("sem"), 50).alias("whole_sem_p50"),
        stats.percentile(F.col("sem"), 90).alias("whole_sem_p90"),
        stats.share_at_least(F.col("sem"), high).alias("whole_highsim_ratio"),
    ]
    if text:
        measures += [stats.percentile(F.col("lex"), p).alias(f"whole_lex_p{p}") for p in (50, 90)] + [stats.pseudo_share(F.col("sem"), F.col("lex")).alias("whole_pseudo_ratio")]
    return found.groupBy(*groups).agg(*measures)


def sentence_measures(sentences: list[tuple[int, str, np.ndarray]], k: int, high: float, gap: float) -> dict:
    """A31 for one group: (text's number, sentence, vector) in order. The k nearest sentence pairs of each pair of texts, then means over these."""
    texts: dict[int, list] = {}
    for number, sentence, vector in sentences:
        texts.setdefault(number, []).append((sentence, vector / max(float(np.linalg.norm(vector)), 1e-300)))
    numbers, rows, compared = sorted(texts), [], 0
    units = {n: np.stack([v for _, v in texts[n]]) for n in numbers}
    for at, a in enumerate(numbers):
        for b in numbers[at + 1 :]:
            sims = (units[a] @ units[b].T).ravel()
            compared += len(sims)
            top = np.argsort(-np.round(sims, 9), kind="stable")[:k]
            width = len(units[b])
            lexical = [ratio(texts[a][i // width][0], texts[b][i % width][0]) for i in top.tolist()]
            rows.append((sims[top[0]], sims[top].mean(), (sims[top] >= high).mean(), (sims[top] - np.array(lexical) > gap).mean()))
    mean = np.array(rows).mean(0).tolist() if rows else [0.0] * 4
    names = ("top1_sent_mean", "topk_sent_mean", "sent_highsim_ratio", "sent_pseudo_ratio")
    return dict(zip(names, mean)) | {"sentence_pair_count": len(rows), "raw_sentence_comparison_count": compared, "sentence_count": len(sentences)}


def sentence_metrics(df: DataFrame, groups: list[str], key: str, text: str, vector: str, k: int = 3, high: float = 0.85, gap: float = 0.3) -> DataFrame:
    """Per group, from a row for each sentence (key: its text's id, `ordinal`), the measures of sentence_measures(). Groups are samples, so a task takes one."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*groups).schema.fields)
    schema = f"{kinds}, top1_sent_mean double, topk_sent_mean double, sent_highsim_ratio double, sent_pseudo_ratio double, sentence_pair_count long, raw_sentence_comparison_count long, sentence_count long"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([key, "ordinal"])
        rows = list(zip(group[key].tolist(), group[text].tolist(), group[vector].map(np.asarray).tolist()))
        rows = [(n, t, np.asarray(v, float)) for n, t, v in rows]
        return pd.DataFrame([{g: group[g].iloc[0] for g in groups} | sentence_measures(rows, k, high, gap)])

    return df.select(*groups, key, "ordinal", text, vector).groupBy(*groups).applyInPandas(run, schema)


def imagery_metrics(df: DataFrame, groups: list[str], key: str, tokens: str, category: str | None = None) -> DataFrame:
    """Soft Jaccard of the token sets of all pairs, with concentration, entropy and number of the tokens, and entropy and number of the categories."""
    found = pairs.within(df, groups, key, [tokens]).select(*groups, set_similarity(f"{tokens}_a", f"{tokens}_b").alias("jac"))
    jac = found.groupBy(*groups).agg(stats.percentile(F.col("jac"), 50).alias("jac_p50"), stats.percentile(F.col("jac"), 90).alias("jac_p90"))
    counts = df.select(*groups, F.explode(tokens).alias("token")).groupBy(*groups, "token").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), "token")))
    spread = ranked.groupBy(*groups).agg(
        (F.sum(F.when(F.col("r") <= 10, F.col("n")).otherwise(0)) / F.sum("n")).alias("top10_conc"), stats.normalized_entropy(F.col("n")).alias("imagery_entropy"),
        F.count("n").alias("distinct_imagery_count"),
    )
    out = jac.join(spread, groups, "left")
    if category is None:
        return out
    kinds = df.filter(F.coalesce(F.col(category), F.lit("")) != "").groupBy(*groups, category).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy(*groups).agg(stats.normalized_entropy(F.col("n")).alias("category_entropy"), F.count("n").alias("distinct_category_count"))
    return out.join(kinds, groups, "left").na.fill(0.0, ["category_entropy"]).na.fill(0, ["distinct_category_count"])


def composite_scores(metrics: DataFrame) -> DataFrame:
    """Whole, sentence, imagery, core and full scores from the metrics' columns."""
    out = metrics.withColumns({"whole_score": stats.weighted(stats.WHOLE), "sent_score": stats.weighted(stats.SENTENCE), "imagery_score": stats.imagery_score()})
    return out.withColumns({"core_score": stats.weighted(stats.CORE), "full_score": stats.weighted(stats.FULL)})


def average_rounds(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the rounds; missing values are skipped."""
    values = [c for c in metrics.columns if c not in (*keys, "round")]
    return metrics.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def against_baseline(metrics: DataFrame, baseline: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Metrics with the human baseline of the same keys and the excess over it, null without one."""
    human = baseline.select(*keys, *[F.col(v).alias(f"human_{v}") for v in values])
    joined = metrics.join(human, keys, "left")
    return joined.withColumns({f"excess_{v}": F.col(v) - F.col(f"human_{v}") for v in values})
