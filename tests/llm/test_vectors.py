"""Vector near-duplicates and exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantorium.llm import embed_dups, topk

ODD = [None, [], [0.0] * 8, [1.0, None, 0, 0, 0, 0, 0, 0], [float("nan")] * 8, [float("inf")] + [1.0] * 7]


def sets(rng, groups, size, singles, dims=8, noise=0.06):
    centres = rng.normal(size=(groups, dims))
    near = (centres[:, None] + noise * rng.normal(size=(groups, size, dims))).reshape(-1, dims)
    return np.concatenate([near, rng.normal(size=(singles, dims))])


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, e string").repartition(4)


def brute(rows, threshold=embed_dups.THRESHOLD):
    good = [(i, np.array(v)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v) in enumerate(good):
        for j, w in good[:k]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, {i: find(i) for i in root}


@pytest.mark.parametrize("part", [embed_dups.PART, 40])
def test_near_duplicates(spark, monkeypatch, part):
    monkeypatch.setattr(embed_dups, "PART", part)
    monkeypatch.setattr(embed_dups, "SHARD", 120)
    rng = np.random.default_rng(1)
    vectors = sets(rng, 6, 40, 120).tolist()
    vectors += [vectors[0]] * 20 + [[-0.0 if x == 0 else x for x in vectors[3]]] + ODD + [[1.0, 2.0], [2.0, 4.1], [3.0, 1e200, 3.0]]
    rows = list(enumerate(vectors))
    got = {r.vec_id: r for r in embed_dups.near_duplicates(frame(spark, rows)).collect()}
    links, roots = brute(rows)
    assert len(got) == len(rows)
    true, found = sum(links.values()), sum(min(got[i].n_links, links[i]) for i in links)
    assert all(got[i].n_links <= links[i] for i in links) and found >= 0.97 * true
    assert sum(got[i].component_id == roots[i] for i in roots) >= 0.97 * len(roots)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    bad = range(len(rows) - len(ODD) - 3, len(rows) - 3)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in bad)


def test_every_link_has_a_shard_on_a_hot_group():
    rng = np.random.default_rng(9)
    total = 200_000
    x = rng.normal(size=(total, 64)).astype(np.float32)
    hot = rng.permutation(total)[: total // 3]
    x[hot] = rng.normal(size=64) + 0.17 * rng.normal(size=(len(hot), 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sample = x[rng.permutation(total)[:4000]]
    asked = hot[:200]
    a, b = np.nonzero(x[asked] @ x[hot].T >= embed_dups.THRESHOLD)
    assert len(a) > 1_000_000

    def covered(centres, whole):
        main, held = embed_dups.places(x[hot], centres, embed_dups.THRESHOLD, whole)
        return (held[b, main[a]] | held[a, main[b]]).mean()  # asked is the head of hot

    loose = embed_dups.fit_centres(sample, 250)
    assert covered(loose / np.linalg.norm(loose, axis=1, keepdims=True), True) == 1
    merged = embed_dups.merge_centres(sample, loose, embed_dups.THRESHOLD)
    assert covered(merged, True) == 1 and ((merged @ x[asked[0]]) > 0.9).sum() == 1 and covered(merged, False) > 0.999
    assert covered(embed_dups.choose_centres(sample, 250, total, embed_dups.THRESHOLD), False) > 0.999


def test_audit_finds_all_links_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(embed_dups, "SHARD", 20)
    rows = list(enumerate(sets(np.random.default_rng(5), 1, 500, 700, dims=32, noise=0.12).tolist()))
    vectors = frame(spark, rows)
    true, got = embed_dups.audit(vectors, embed_dups.near_duplicates(vectors), most=1200)
    assert true > 50_000 and got == true


def test_recall_of_many_small_groups(spark):
    vectors = sets(np.random.default_rng(6), 550, 20, 7000, dims=32, noise=0.2)
    frames = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in embed_dups.near_duplicates(frames).collect()}
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    true = np.concatenate([(x[i : i + 1000] @ x.T >= embed_dups.THRESHOLD).sum(1) - 1 for i in range(0, len(x), 1000)])
    assert true.sum() > 40_000 and sum(min(got[i], int(t)) for i, t in enumerate(true)) >= 0.99 * true.sum()
    assert all(got[i] <= t for i, t in enumerate(true))


def test_a_low_recall_is_repaired(spark, monkeypatch):
    rows = list(enumerate(sets(np.random.default_rng(7), 6, 30, 60).tolist()))
    monkeypatch.setattr(embed_dups, "LEAST_RECALL", 1.1)  # so that every run is searched exhaustively
    got = {r.vec_id: r for r in embed_dups.near_duplicates(frame(spark, rows)).collect()}
    links, roots = brute(rows)
    assert all(got[i].n_links == links[i] and got[i].component_id == roots[i] for i in links)


def test_audit_and_edges(spark):
    rows = list(enumerate(sets(np.random.default_rng(2), 3, 20, 10).tolist()))
    vectors = frame(spark, rows)
    found = embed_dups.near_duplicates(vectors)
    true, got = embed_dups.audit(vectors, found)
    assert 0 < true and got >= 0.9 * true
    twice = frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])
    rows = embed_dups.near_duplicates(twice).collect()
    assert sorted((r.vec_id or -1, r.n_links) for r in rows) == [(-1, 0), (1, 1), (1, 1)]
    mixed = frame(spark, [(1, [1.0, 2.0]), (1, [2.0, -1.0]), (2, [1.0, 2.01]), (3, [4.0, -2.0])])
    rows = embed_dups.near_duplicates(mixed).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    assert embed_dups.near_duplicates(vectors.limit(0)).collect() == [] and embed_dups.audit(vectors.limit(0), found) == (0, 0)


@pytest.mark.parametrize("size", [1024, 16])
def test_topk(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "LEAST_BLOCK", size)
    monkeypatch.setattr(topk, "BLOCK", size)
    monkeypatch.setattr(topk, "STEP", 32)
    monkeypatch.setattr(topk, "SAMPLE", 60)
    vectors = sets(np.random.default_rng(3), 4, 30, 200).tolist()
    vectors += [vectors[0]] * 15 + [[0.0] * 8] + [v for v in ODD if v is None or v != [0.0] * 8]
    rows = list(enumerate(vectors))
    got = {}
    for r in topk.search(frame(spark, rows), F.col("vec_id") % 9 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    assert set(got) == {i for i in ints if i % 9 == 0}
    for q in got:
        order = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, -s, i) for k, (s, i) in enumerate(order)]


@pytest.mark.parametrize("size", [2.0**16, 2.0**20, 2.0**26, 2.0**60, 1e290])
def test_topk_is_exact_for_large_components(spark, size):
    rng = np.random.default_rng(11)
    rows = list(enumerate((size * rng.normal(size=(40, 8))).tolist()))
    ints = {i: [int(x) for x in np.floor(1024 * np.array(v))] for i, v in rows}
    got = {}
    for r in topk.search(frame(spark, rows), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for q in (0, 10, 20, 30):
        order = sorted((-clip(sum(a * b for a, b in zip(ints[q], ints[i]))), i) for i in ints if i != q)[:10]
        mine = sorted(got[q])
        assert [(r, s) for r, s, _ in mine] == [(k + 1, -s) for k, (s, _) in enumerate(order)]
        if size < 2.0**21:
            assert [i for *_, i in mine] == [i for _, i in order]


def test_topk_few_rows(spark):
    few = frame(spark, [(0, [1.0, 2.0]), (100, [1.0]), (7, [3.0, -1.0]), (None, [9.0, 9.0])])
    got = sorted(tuple(r) for r in topk.search(few, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 7, 1 << 20), (0, 2, 100, 1 << 20), (100, 1, 7, 3 << 20), (100, 2, 0, 1 << 20)]
    assert topk.search(few.limit(0), F.col("vec_id") == 0).collect() == []
