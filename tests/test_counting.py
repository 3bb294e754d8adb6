"""Tokens of groups are counted once, and only those that can be among the first are put in order."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cantorium.operators import descriptive as D
from cantorium.plans import registry
from cantorium.plans.common import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c"]), " ".join(rng.choice(["x", "y", "Z", "w1v", "é", "u-u"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(90, "d", None), (91, "d", "only"), (92, None, "x x"), (93, "a", "")]
    return rows, spark.createDataFrame(rows, "doc_id long, g string, text string").repartition(3)


def tokens(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_tokens_and_overlap_against_loops(docs, k):
    """with ties at the k-th count."""
    rows, df = docs
    n, seen = {}, {}
    for _, g, t in rows:
        n.setdefault(g, Counter()).update(tokens(t))
        seen.setdefault(g, Counter()).update(set(tokens(t)))
    coverage = D.token_coverage(df, ["g"], words(F.col("text")))
    assert {(r.g, r.token): (r.n, r.docs) for r in coverage.collect()} == {(g, w): (c, seen[g][w]) for g in n for w, c in n[g].items()}
    top = {g: sorted(n[g], key=lambda w: (-n[g][w], w))[:k] for g in n if g}
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("group_docs"))
    assert {(r.g, r["rank"]): r.token for r in D.top_tokens(coverage, sizes, ["g"], k).collect()} == {(g, i + 1): w for g in top for i, w in enumerate(top[g])}
    every = sum((n[g] for g in n), Counter())
    first = D.top_tokens(D.widened(coverage, []), df.agg(F.count(F.lit(1)).alias("group_docs")), [], k).collect()
    assert {r["rank"]: r.token for r in first} == {i + 1: w for i, w in enumerate(sorted(every, key=lambda w: (-every[w], w))[:k])}
    found = D.vocabulary_overlap(coverage, "g", k)
    assert "token#" not in found._jdf.queryExecution().toString()  # tokens are not joined
    shared = {(a, b): (len(set(n[a]) & set(n[b])), len(set(n[a]) | set(n[b])), len(set(top[a]) & set(top[b]))) for a in top for b in top if a < b}
    assert {(r.a, r.b): (r.common, r.union_size, r.top_common) for r in found.collect()} == shared


def test_top_tokens_split_the_texts_once(spark):
    """totals and ranks read counted tokens."""
    assert "Generate" not in registry.QUERIES["token_top_by_group"](spark, SF)._jdf.queryExecution().toString()
