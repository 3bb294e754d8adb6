"""Literal fixtures of scalars and aggregates, and plain-Python models on random inputs."""

import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cantorium.functions import lexical, stats, text
from cantorium.operators import quantiles


def value(spark, column, **inputs):
    names = list(inputs)
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in inputs.items())
    df = spark.createDataFrame([tuple(inputs.values())], kinds) if names else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("given_, function, expected", [
    ("明月几时有，把酒问青天。\n不知天上宫阙，", text.sentences, ["明月几时有", "把酒问青天", "不知天上宫阙"]),
    ("　春 风　。", text.sentences, ["春 风"]),
    (None, text.sentences, []),
    ("明月明月有", text.char_ngrams, ["明月", "月明", "月有"]),
    ("月", text.char_ngrams, ["月"]),
    ("", text.char_ngrams, []),
    ('["白玉兰"," 明月，"]', text.json_list, ["玉兰", "明月"]),
    ('{"a":1}', text.json_list, []),
    ("bad", text.json_list, []),
    (None, text.json_list, []),
    ('[" a ", null, ""]', text.error_list, ["a"]),
    ("减字木兰花", text.core_tune, "木兰花"),
    ("浪淘沙慢", text.core_tune, "浪淘沙"),
    ("祝英台近", text.core_tune, "祝英台"),
    ("平声一东", text.rhyme_group, "东"),
    ("去声二十三（独用）漾韵", text.rhyme_group, "漾"),
    ("六十六", text.zh_number, 66),
    ("一百一十四", text.zh_number, 114),
    ("十", text.zh_number, 10),
    ("12,3.4|*5", text.slot_count, 5),
    ("<a & \"b\">", text.html_escape, "&lt;a &amp; &quot;b&quot;&gt;"),
    ("  Hello, 世界! x ", text.slug, "hello-世界-x"),
])
def test_text_fixtures(spark, given_, function, expected):
    df = spark.createDataFrame([(given_,)], "x string")
    assert df.select(function(F.col("x")).alias("v")).first().v == expected


def test_merged_and_repair(spark):
    assert value(spark, text.merged_characters(F.col("a"), F.col("b")), a="东风", b="风中a") == "东风中"
    df = spark.createDataFrame([("1241", 3), ("1241", 9), ("111", 3)], "s string, n int")
    assert [r.v for r in df.select(text.repair_pattern(F.col("s"), F.col("n")).alias("v")).collect()] == ["141", "1241", "111"]
    assert value(spark, text.expected_length(F.col("m"), F.col("b")), m="双调六十六字", b="") == 66
    assert value(spark, text.expected_length(F.col("m"), F.col("b")), m="", b="定格一百一十四字") == 114
    assert value(spark, text.number(F.col("a")), a="x") == 0.0 and value(spark, text.number(F.col("a")), a="1.5") == 1.5
    assert value(spark, text.fixed(F.col("a")), a=0.25) == "0.2500"


def test_sequence_ratio_fixtures():
    assert [lexical.ratio(*p) for p in (("abcd", "bcde"), ("tide", "diet"), ("diet", "tide"), ("", ""))] == [0.75, 0.25, 0.5, 1.0]
    assert [lexical.token_overlap(*p) for p in (("明月", "明月"), ("月", "明月"), ("明月", "明日"), ("春风", "秋雨"))] == [1.0, 0.85, 0.5, 0.0]
    assert lexical.soft_jaccard({"明月", "孤舟"}, {"月", "孤舟", "西风"}) == pytest.approx(2 / 3) and lexical.soft_jaccard(set(), set()) == 0.0
    assert [lexical.json_array(x) for x in ("```json\n[1]\n```", '{"a":1}', "noise [1,2] tail", "none", "[x] [3]", None)] == ["[1]", '[{"a":1}]', "[1,2]", None, "[3]", None]


def test_ratio_udf(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "a"), ("x" * 300, "x" * 300)], "a string, b string")
    assert [r.v for r in df.select(lexical.seq_ratio("a", "b").alias("v")).collect()] == [0.75, 0.0, difflib.SequenceMatcher(None, "x" * 300, "x" * 300).ratio()]


@given(st.sets(st.text("abc明月", max_size=3), max_size=5), st.sets(st.text("abc明月", max_size=3), max_size=5))
@settings(max_examples=60, deadline=None)
def test_soft_jaccard_bounds(a, b):
    assert 0 <= lexical.soft_jaccard(a, b) <= 1
    if a == b and a and "" not in a:
        assert lexical.soft_jaccard(a, b) == 1


@given(st.sets(st.text("abcdé明月Ā", max_size=6), max_size=7), st.sets(st.text("abcdé明月Ā", max_size=6), max_size=7))
@settings(max_examples=300, deadline=None)
def test_soft_jaccard_tries_every_pair_that_counts(a, b):
    left, rest, matched = sorted(a), sorted(b), 0
    total = len(left) + len(rest)
    for token in left if rest else []:
        scores = [lexical.token_overlap(token, other) for other in rest]
        if scores and max(scores) >= 0.67:
            rest.pop(scores.index(max(scores)))
            matched += 1
    assert lexical.soft_jaccard(a, b) == pytest.approx(matched / (total - matched) if matched else 0.0)


def test_statistics_fixtures(spark):
    five = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 8.0, 16.0)], "x double")
    points = {f"p{p}": p for p in (25, 50, 75, 90, 95)}
    row = five.agg(*[stats.percentile(F.col("x"), p).alias(n) for n, p in points.items()]).first()
    assert list(row) == pytest.approx([2, 4, 8, 12.8, 14.4]) and list(quantiles.percentiles(five, [], "x", points).first()) == pytest.approx([2, 4, 8, 12.8, 14.4])
    assert list(quantiles.floor_percentiles(five, [], "x", points).first()) == [2, 4, 8, 8, 8]
    counts = spark.createDataFrame([(3,), (1,)], "n long").agg(stats.entropy_bits(F.col("n")), stats.normalized_entropy(F.col("n")), stats.herfindahl(F.col("n"))).first()
    assert list(counts) == pytest.approx([0.811278, 0.811278, 0.625], abs=1e-6)
    assert spark.createDataFrame([(5,)], "n long").agg(stats.normalized_entropy(F.col("n")).alias("v")).first().v == 0
    from cantorium.operators.pairs import binned_entropy

    values = spark.createDataFrame([("g", x) for x in (-0.2, -0.01, 0.0, 0.5, 0.99, 1.0)], "g string, x double")
    assert binned_entropy(values, ["g"], "x").first().binned_entropy == pytest.approx(0.443852, abs=1e-6)
    lengths = spark.createDataFrame([("x" * n,) for n in (5, 6, 8, 9, 11, 12, 14, 15)], "t string")
    assert [r.v for r in lengths.select(stats.length_bucket(F.col("t")).alias("v")).collect()] == ["<=5", "6-8", "6-8", "9-11", "9-11", "12-14", "12-14", "15+"]
    marks = spark.createDataFrame([(x,) for x in (100.0, 99.9991, 80.0, 79.9, 60.0, 59.0, 0.0, None)], "s double")
    assert [r.v for r in marks.select(stats.score_bucket(F.col("s")).alias("v")).collect()] == ["100", "100", "80_99", "60_79", "60_79", "1_59", "0", "0"]
    axis = spark.createDataFrame([(0.1, 0.1, -0.3)], "w double, s double, i double")
    both = axis.select(stats.dominant_axis(F.col("w"), F.col("s"), F.col("i")).alias("a"), stats.dominant_axis(F.col("w"), F.col("s"), F.col("i"), True).alias("b")).first()
    assert (both.a, both.b) == ("whole", "imagery")


def test_runs_and_ranks(spark):
    from cantorium.operators import scores

    rows = [("p", i, v) for i, v in enumerate(["a", "a", "b", "b", "b", ""])] + [("q", 0, ""), ("q", 1, "")]
    got = {r.g: r.longest_run for r in scores.longest_run(spark.createDataFrame(rows, "g string, i int, v string"), ["g"], "i", "v").collect()}
    assert got == {"p": 3, "q": 0}
    base = spark.createDataFrame([("g", x) for x in (0.1, 0.2, 0.2, 0.4)], "g string, v double")
    asked = spark.createDataFrame([("g", 1, 0.2), ("g", 2, 0.05), ("h", 3, 0.3)], "g string, i int, v double")
    assert {r.i: r.percentile_rank for r in scores.percentile_rank(asked, base, ["g"], "i", "v").collect()} == {1: 0.75, 2: 0.0, 3: None}


def test_percentiles_of_groups_against_sorted_lists(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-9, 9)])) for _ in range(500)] + [("c", 3)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    own = {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("a", "b", "c", None)}
    low = {r.g: (r.x, r.y) for r in quantiles.floor_percentiles(df, ["g"], "v", {"x": 25, "y": 90}).collect()}
    assert low == {g: (v[int(0.25 * (len(v) - 1))], v[int(0.9 * (len(v) - 1))]) for g, v in own.items()}
    shares = {(r.g, r.v): r.share for r in quantiles.cumulative_share(df, ["g"], "v").collect()}
    assert shares == {(g, x): sum(y <= x for y in v) / len(v) for g, v in own.items() for x in v}


def test_composite_scores_follow_the_formulas(spark):
    from cantorium.operators.homogeneity import composite_scores

    rng = random.Random(8)
    names = ["whole_sem_p50", "whole_sem_p90", "whole_highsim_ratio", "sent_highsim_ratio", "sent_pseudo_ratio", "top1_sent_mean", "jac_p50", "jac_p90", "top10_conc", "imagery_entropy", "category_entropy"]
    m = {n: rng.random() for n in names}
    got = composite_scores(spark.createDataFrame([tuple(m.values())], ", ".join(f"{n} double" for n in names))).first()
    whole = 0.5 * m["whole_sem_p50"] + 0.3 * m["whole_sem_p90"] + 0.2 * m["whole_highsim_ratio"]
    sent = 0.4 * m["sent_highsim_ratio"] + 0.3 * m["sent_pseudo_ratio"] + 0.3 * m["top1_sent_mean"]
    imagery = 0.35 * m["jac_p50"] + 0.25 * m["jac_p90"] + 0.2 * m["top10_conc"] + 0.1 * (1 - m["imagery_entropy"]) + 0.1 * (1 - m["category_entropy"])
    assert got.core_score == pytest.approx(0.55 * whole + 0.45 * sent) and got.full_score == pytest.approx(0.45 * whole + 0.35 * sent + 0.2 * imagery)
