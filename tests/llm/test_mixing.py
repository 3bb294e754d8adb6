"""Targets, nearness, repeatability and edge cases of mixing, and its SQL."""

import random
import re

import pytest

import oracle
from cantorium.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes: dict, weights=mixing.WEIGHTS, most=mixing.MOST_REPEATS):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.fixture
def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}", "x", 7) for i in range(400)]
    rows += [(1000 + i, "tiny source", "s4", "x", 7) for i in range(3)]
    rows += [(2000, None, None, "x", 7), (2001, "", None, "x", 7), (None, "no id here", None, "x", 7)]
    rows += [(3000, "same row", "s1", "x", 7)] * 3 + [(3001, "long " * 3000, "s2", "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, positions string, key int").repartition(5)


def test_plan_meets_targets(spark, docs):
    rows = mixing.plan(docs).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == r.size * len(r.positions) <= 3 * r.size and list(r.positions) == sorted(r.positions)
        assert all(0 <= p <= 1 for p in r.positions)
    want = shares(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.03 * want[s]), (s, taken[s], want[s])
    again = mixing.plan(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_mix_rows_follow_plan(spark, docs):
    rows = mixing.mix(docs).collect()
    assert rows[0].__fields__ == docs.columns
    count = {}
    for r in rows:
        count[(r.doc_id, r.source)] = count.get((r.doc_id, r.source), 0) + 1
    want = {}
    for r in mixing.plan(docs).collect():
        if r.positions:
            want[(r.doc_id, r.source)] = want.get((r.doc_id, r.source), 0) + len(r.positions)
    assert count == want


def test_mix_keeps_rows_that_differ_in_another_column(spark):
    schema = "doc_id long, text string, source string, lang string, __mix_at int, row string, tags map<string,int>"
    rows = [(1, "a b c", "s", "en", 1, "r", {"a": 1}), (1, "a b c", "s", "de", 1, "r", None), (1, "a b c", "s", "de", 1, "r", None), (None, "x y", "s", "fr", 2, None, {})]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = mixing.mix(docs, weights=(1,), curves=(((0.0, 1.0), (1.0, 1.0)),)).collect()
    assert got[0].__fields__ == docs.columns
    assert sorted(map(repr, got)) == sorted(map(repr, docs.collect()))


def test_a_third_of_the_rows_under_one_id(spark):
    rows = [(7, f"w{i} " * (i % 9), "s") for i in range(300)] + [(None, "same words", "s")] * 300 + [(1000 + i, "a b", "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.plan(docs).collect()
    assert len(got) == 900 and all(r.taken == r.size * len(r.positions) <= 3 * r.size for r in got)
    for s in "st":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8
    key = lambda r: (r.doc_id or -1, r.source, r.size, tuple(r.positions))
    assert sorted(map(key, mixing.plan(docs.repartition(2)).collect())) == sorted(map(key, got))


def test_targets_of_many_sources(spark):
    rng = random.Random(9)
    sizes = {f"s{i:04d}": rng.choice([0, 1, 10, 100, 10_000]) for i in range(700)}
    totals = spark.createDataFrame([(f"a{k}", v) for k, v in sizes.items()], "source_key string, source_size long").repartition(7)
    got = {r.source_key[1:]: r.target for r in mixing.targets(totals).collect()}
    assert got == pytest.approx(shares(sizes))


def test_inverse_demand_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for curve in mixing.CURVES:
        total = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(curve, curve[1:]))
        for row in spark.range(21).select((F.col("id") / 20.0).alias("y")).withColumn("t", mixing.inverse_demand(F.col("y"), curve)).collect():
            area = 0.0
            for (t0, a), (t1, b) in zip(curve, curve[1:]):
                end = min(max(row.t, t0), t1)
                here = a + (b - a) * (end - t0) / (t1 - t0)
                area += (end - t0) * (a + here) / 2
            assert area / total == pytest.approx(row.y, abs=1e-9)


def test_empty(spark, docs):
    assert mixing.plan(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []


def test_sql(spark):
    oracle.same(spark, queries.QUERIES["op2_curriculum_mixing"], queries.ORACLES["op2_curriculum_mixing"], "/root/testdata/sf0.001")
