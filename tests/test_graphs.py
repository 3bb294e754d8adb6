"""Label propagation by lists of neighbours and by joins, against plain Python."""

import random

import pytest

from cantorium.operators import graph


def plain(edges, rounds=graph.ROUNDS):
    near = {}
    for s, a, b, w in edges:
        near.setdefault((s, a), []).append((b, w))
        near.setdefault((s, b), []).append((a, w))
    labels = {k: k[1] for k in near}
    for _ in range(rounds):
        new = {}
        for (s, a), others in near.items():
            votes = {}
            for b, w in others:
                votes[labels[s, b]] = votes.get(labels[s, b], 0.0) + w
            most = max(round(v, 9) for v in votes.values())
            best = [c for c, v in votes.items() if round(v, 9) == most]
            new[s, a] = labels[s, a] if labels[s, a] in best else min(best)
        changed, labels = new != labels, new
        if not changed:
            break
    return {k: min(n for s, n in labels if s == k[0] and labels[s, n] == c) for k, c in labels.items()}


@pytest.mark.parametrize("rounds", [1, 2, 30])
def test_propagation_both_ways(spark, monkeypatch, rounds):
    """F16: edges are dealt out once, not in each round."""
    rng = random.Random(5)
    edges = [(s, 10 * a, 10 * b, rng.choice([0.25, 0.5, 1.0])) for s, n in (("s", 40), ("t", 9), ("", 25)) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.5 if a // 8 == b // 8 else 0.04)]
    df = spark.createDataFrame(edges, "scope string, src long, dst long, weight double").repartition(5)
    joins = []
    monkeypatch.setattr(graph, "_by_joins", lambda *a, f=graph._by_joins: joins.append(a) or f(*a))
    want = plain(edges, rounds)
    assert {(r.scope, r.node): r.community for r in graph.propagate(df, rounds).collect()} == want and not joins
    monkeypatch.setattr(graph, "MOST_NODES", 20)
    assert {(r.scope, r.node): r.community for r in graph.propagate(df, rounds).collect()} == want and joins
