"""Aggregates and scalars of the statistics: percentiles, entropies, concentration, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(value: Column) -> Column:
    """A3: 0 when there is nothing."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def percentile(value: Column, p: float) -> Column:
    """A4: linear interpolation, exact; 0 when there is nothing."""
    return F.coalesce(F.percentile(value, F.lit(p / 100)), F.lit(0.0))


def entropy_bits(count: Column) -> Column:
    """Shannon entropy of counts, one row a class: log2(N) - sum(c log2 c)/N."""
    total = F.sum(count)
    return F.coalesce(F.log2(total) - F.sum(count * F.log2(count)) / total, F.lit(0.0))


def normalized_entropy(count: Column) -> Column:
    """Entropy over that of as many equal classes; 0 for one class."""
    classes = F.count(count)
    return F.when(classes > 1, entropy_bits(count) / F.log2(classes)).otherwise(0.0)


def herfindahl(count: Column) -> Column:
    """A10."""
    return F.sum(count * count) / (F.sum(count) * F.sum(count))


def share_at_least(value: Column, threshold: float) -> Column:
    """A12."""
    return mean((value >= threshold).cast("double"))


def pseudo_share(semantic: Column, lexical: Column, gap: float = 0.3) -> Column:
    """How often the meaning is this much nearer than the wording."""
    return mean((semantic - lexical > gap).cast("double"))


def summary(value: Column) -> list[Column]:
    """Count, mean, p50, p90, p95, p99, max; null when there is nothing."""
    cuts = [F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 95, 99)]
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), *cuts, F.max(value).alias("max")]


def unit_bin(value: Column, bins: int = 20) -> Column:
    """Bin of a value over [0, 1], the last one closed; truncates towards zero, so values just below 0 share bin 0."""
    return F.least((value / F.lit(1.0 / bins)).cast("int"), F.lit(bins - 1))


# Weights of the composite scores.
WHOLE = {"whole_sem_p50": 0.5, "whole_sem_p90": 0.3, "whole_highsim_ratio": 0.2}
SENTENCE = {"sent_highsim_ratio": 0.4, "sent_pseudo_ratio": 0.3, "top1_sent_mean": 0.3}
CORE = {"whole_score": 0.55, "sent_score": 0.45}
FULL = {"whole_score": 0.45, "sent_score": 0.35, "imagery_score": 0.2}


def weighted(parts: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    return total


def imagery_score() -> Column:
    return 0.35 * F.col("jac_p50") + 0.25 * F.col("jac_p90") + 0.2 * F.col("top10_conc") + 0.1 * (1 - F.col("imagery_entropy")) + 0.1 * (1 - F.col("category_entropy"))


def composite(median: Column, p90: Column) -> Column:
    """A34."""
    return 0.55 * median + 0.45 * p90


def cosine(a: Column, b: Column) -> Column:
    """in double precision, whatever the vectors' type."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return product(a, b) / F.sqrt(product(a, a) * product(b, b))


def length_bucket(text: Column) -> Column:
    """P14."""
    n = F.length(text)
    return F.when(n <= 5, "<=5").when(n <= 8, "6-8").when(n <= 11, "9-11").when(n <= 14, "12-14").otherwise("15+")


def score_bucket(score: Column) -> Column:
    """P13."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= 99.999, "100").when(s >= 80, "80_99").when(s >= 60, "60_79").when(s > 0, "1_59").otherwise("0")


BUCKETS = ("100", "80_99", "60_79", "1_59", "0")

# Kinds of issues by what their messages hold, first match first.
ISSUES = (
    ("length_mismatch", ("字数不符",)),
    ("variant_autocorrect", ("智能纠偏",)),
    ("rhyme_mismatch", ("韵脚",)),
    ("tone_expected_flat", ("须填平声字",)),
    ("tone_expected_oblique", ("须填仄声字",)),
    ("rhyme_mismatch", ("出韵", "押")),
    ("unknown_char", ("未收录",)),
)
ISSUE_TYPES = (*dict.fromkeys(k for k, _ in ISSUES), "other")


def issue_type(message: Column) -> Column:
    """P12."""
    kind = None
    for name, marks in ISSUES:
        hit = message.contains(marks[0])
        for mark in marks[1:]:
            hit = hit | message.contains(mark)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.otherwise("other")


def dominant_axis(whole: Column, sentence: Column, imagery: Column, by_size: bool = False) -> Column:
    """The name of the largest of three deltas (or of their sizes), ties to the greater name."""
    axes = zip(("whole", "sentence", "imagery"), (whole, sentence, imagery))
    return F.array_max(F.array(*[F.struct((F.abs(v) if by_size else v).alias("v"), F.lit(n).alias("name")) for n, v in axes]))["name"]


def status(mode: Column, n_poems: Column, n_tunes: Column, n_used: Column, least_poems: int = 30, least_tune_poems: int = 8) -> Column:
    """Of a model in an experiment, by the experiment's mode and the poems and tunes that could be used."""
    enough = n_poems >= least_poems
    pooled = enough & (n_tunes >= 3) & (n_used >= 3 * least_tune_poems)
    main = F.when(mode == "single_cipai", enough & (n_tunes >= 1)).otherwise(pooled)
    return F.when(n_tunes == 0, "insufficient_usable_cipai").when(mode == "free", "exploratory").when(main, "main").otherwise("low_sample")


def threat(semantic: Column, lexical: Column) -> Column:
    """P17."""
    return F.greatest(semantic, 2 * lexical)


def suspicious(semantic: Column, lexical: Column, least_semantic: float = 0.82, least_lexical: float = 0.35) -> Column:
    """P9."""
    return (semantic >= least_semantic) | (lexical >= least_lexical)


def hidden(semantic: Column, lexical: Column, least: float = 0.8, most: float = 0.45) -> Column:
    """P8."""
    return (semantic >= least) & (lexical <= most)
