"""Near-duplicate vectors by cosine, found on a robust-pruned flat graph.

Equal vectors are one node. Nodes go to the shard of their nearest cluster centre and to those of other centres that a link
may lead to, so shards overlap. Two nodes with different nearest centres lie on either side of the plane midway between
these, and if they are linked, one of them is within half their distance of that plane, so with a margin of half the
longest link both share a shard. Of a link in a random direction only a part of about 1 / sqrt(dimensions) points at the
plane, so a margin of REACH such parts reaches nearly all links at a fraction of the overlap; the audit below tells if it
does. Centres nearer to each other than a link are one, so a hot group is not torn. A cluster that is too large for one task
is dealt into parts, and every pair of parts is a shard, so none of its links is out of reach.

In each shard a node's nearest nodes and some far ones are pruned robustly to a short adjacency list, to which the nearest
of those that list it are added; a node's lists from all its shards are united, and cut to bounded length in each shard
that reads them. A greedy search enters a shard's graph at medoids alone and walks towards the query; a query whose own
node it did not meet goes on from there too. Then it expands through everything in range. What it finds is checked in
double precision.

Every run is audited: the links of a bounded sample of rows are found by brute force against all rows. A recall under
LEAST_RECALL makes the run place nodes with the whole margin and search its shards exhaustively, which finds all links.

Links inside a cluster are handed on as counts for each node and a spanning forest, links across clusters as pairs, so a
group of b near copies in one cluster gives about b rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths do not link; a null id keeps a null component and is never the smallest id; repeated rows link with
each other like any equal vectors; an empty table gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantorium.llm.components import components
from cantorium.llm.rows import attach, sampled
from cantorium.llm.simhash import _forest
from cantorium.llm.vectors import as_double, usable
from cantorium.session import materialize

THRESHOLD = 0.95
#: Nodes that a shard should have, and the most that one part of a cluster may have.
SHARD, PART = 800, 4096
MOST_CENTRES = 4096
#: Nodes, by hashes, on which centres are fitted: 20,000, or more for many centres, but never more bytes than this.
CENTRE_SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
NEAREST, FAR, DEGREE, FAR_DEGREE, REVERSE, ALPHA = 40, 12, 16, 6, 16, 1.2
#: Longest list that a search reads.
WIDTH = 96
MEDOIDS, HOPS, SLACK = 8, 16, 0.05
#: Parts of a link towards a plane that the margin of a cluster covers.
REACH = 2.5
QUERIES = 256
#: Rows whose links an audit finds by brute force.
AUDITED = 64
LEAST_RECALL = 0.9
_log = logging.getLogger(__name__)


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample (which is in hash order)."""
    if not len(sample):
        return np.zeros((1, 1))
    k = max(1, min(k, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 else 0):
        own = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def merge_centres(sample: np.ndarray, centres: np.ndarray, threshold: float) -> np.ndarray:
    """The centres without those nearer than the threshold to one with more rows of the sample."""
    weight = np.zeros(len(centres), np.int64)
    for i in range(0, len(sample), 4096):
        weight += np.bincount((sample[i : i + 4096] @ centres.T).argmax(1), minlength=len(centres))
    kept: list[int] = []
    for c in np.argsort(-weight, kind="stable").tolist():
        if not kept or (centres[kept] @ centres[c]).max() < threshold:
            kept.append(c)
    return centres[kept]


def places(e: np.ndarray, centres: np.ndarray, threshold: float, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For rows of length 1: each row's nearest centre, and which centres' shards it goes to (rows x centres).

    With the whole margin, rows within the threshold of each other always share one; else all but very few do.
    """
    reach = np.sin(np.arccos(np.clip(threshold, -1, 1)) / 2)
    if not whole:
        reach *= min(1.0, REACH / e.shape[1] ** 0.5)
    between = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    sims = e @ centres.T
    main = sims.argmax(1)
    return main, sims[np.arange(len(e)), main][:, None] - sims <= reach * between[main] + 1e-9


def choose_centres(sample: np.ndarray, k: int, total: int, threshold: float, whole: bool = False) -> np.ndarray:
    """At most k centres, as many as make the shards' work least: the squares of their sizes, twice for those in parts."""
    best, least = fit_centres(sample, 1), float("inf")
    if k == 1 or not len(sample):
        return best
    for many in sorted({1, *(max(1, k >> i) for i in range(0, 11, 2))}):
        centres = fit_centres(sample, many) if many > 1 else best
        centres = merge_centres(sample, centres / np.linalg.norm(centres, axis=1, keepdims=True), threshold)
        held = sum(places(sample[i : i + 1024], centres, threshold, whole)[1].sum(0) for i in range(0, len(sample), 1024))
        size = held * (total / len(sample))
        work = float((size**2 * np.where(size > PART, 2, 1)).sum())
        if work < least:
            best, least = centres, work
    return best


def _pruned(x: np.ndarray, rows: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) those that no kept one is much nearer to than the row is."""
    points = x[near]
    gap = 2 - 2 * np.einsum("rd,rcd->rc", x[rows], points)
    alive = (near >= 0) & (near != rows[:, None])
    kept = np.full((len(rows), degree), -1)
    all_rows = np.arange(len(rows))
    for r in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        kept[some, r] = near[all_rows, first][some]
        between = 2 - 2 * np.einsum("rd,rcd->rc", points[all_rows, first], points)
        alive &= ALPHA**2 * between > gap
        alive[all_rows, first] = False
    return kept


def adjacency(x: np.ndarray) -> np.ndarray:
    """Out-neighbours of every row of a shard, -1 for none."""
    n = len(x)
    rng = np.random.default_rng(n)
    near, far, found = min(NEAREST, n - 1), min(FAR, n - 1), []
    for at in range(0, n, QUERIES):
        rows = np.arange(at, min(at + QUERIES, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        top = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near else np.zeros((len(rows), 0), int)
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
        away = rng.integers(0, n, (len(rows), far))
        found.append(np.concatenate([_pruned(x, rows, top, DEGREE), _pruned(x, rows, away, FAR_DEGREE)], axis=1))
    forward = np.concatenate(found)
    return np.concatenate([forward, _reverse(x, forward)], axis=1)


def _reverse(x: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """For every row the REVERSE nearest of the rows that list it, -1 for none."""
    listed = np.full((len(forward), REVERSE), -1)
    at, place = np.nonzero(forward >= 0)
    to = forward[at, place]
    order = np.lexsort((at, -np.einsum("id,id->i", x[at], x[to]), to))
    at, to = at[order], to[order]
    rank = np.arange(len(to)) - np.searchsorted(to, to)
    near = rank < REVERSE
    listed[to[near], rank[near]] = at[near]
    return listed


def _cut(x: np.ndarray, row: int, near: np.ndarray) -> np.ndarray:
    """The WIDTH nearest of a row's list."""
    return near if len(near) <= WIDTH else near[np.argsort(-(x[near] @ x[row]), kind="stable")[:WIDTH]]


def medoids(x: np.ndarray) -> np.ndarray:
    """Nodes nearest to a few means of the shard."""
    means = fit_centres(x, min(MEDOIDS, len(x)), 4)
    return np.unique((x @ means.T).argmax(0))


def range_search(x: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query row, found row) with a similarity of at least the threshold."""
    n = len(x)
    width = max(1, max((len(g) for g in graph), default=1))
    full = np.repeat(np.arange(n)[:, None], width, axis=1)  # padded with the node itself
    for i, g in enumerate(graph):
        full[i, : len(g)] = g
    enter = medoids(x)
    for at in range(0, len(queries), QUERIES):
        own = queries[at : at + QUERIES]
        q = len(own)
        sims, open_ = np.full((q, n), -np.inf), np.zeros((q, n), bool)

        def meet(marked: np.ndarray) -> None:
            a, b = np.nonzero(marked & (sims == -np.inf))
            for i in range(0, len(a), 1 << 16):
                ai, bi = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                sims[ai, bi] = np.einsum("id,id->i", x[own[ai]], x[bi])
            open_[a, b] = True

        def expand(a: np.ndarray, b: np.ndarray) -> None:
            open_[a, b] = False
            marked = np.zeros((q, n), bool)
            for i in range(0, len(a), 1 << 14):
                marked[a[i : i + (1 << 14), None], full[b[i : i + (1 << 14)]]] = True
            meet(marked)

        first = np.zeros((q, n), bool)
        first[:, enter] = True
        meet(first)
        for _ in range(HOPS):
            best = np.where(open_, sims, -np.inf).argmax(1)
            able = np.flatnonzero(open_[np.arange(q), best])
            if not len(able):
                break
            expand(able, best[able])
        missed = np.zeros((q, n), bool)
        missed[np.arange(q), own] = True
        meet(missed)
        while True:
            a, b = np.nonzero(open_ & (sims >= threshold - SLACK))
            if not len(a):
                break
            expand(a, b)
        a, b = np.nonzero(sims >= threshold)
        yield own[a[own[a] != b]], b[own[a] != b]


def exhaustive(x: np.ndarray, queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What range_search() gives, by trying all."""
    for at in range(0, len(queries), QUERIES):
        own = queries[at : at + QUERIES]
        a, b = np.nonzero(x[own] @ x.T >= threshold - 1e-9)
        sure = (np.einsum("id,id->i", x[own[a]], x[b]) >= threshold) & (own[a] != b)
        yield own[a[sure]], b[sure]


_PLACED = "cluster long, main boolean, node long, n long, e array<double>"
#: Clusters of vectors of one length are numbered from the length times this on.
_LENGTH = 1 << 20


def _scaled(e: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    e = e / np.abs(e).max(1, keepdims=True)  # no overflow below
    return e / np.linalg.norm(e, axis=1, keepdims=True)


def _place(nodes: DataFrame, centres: dict[int, np.ndarray], threshold: float, whole: bool) -> DataFrame:
    """Each node in the clusters of places(); main: the nearest. Vectors are scaled to length 1; a length without centres has one cluster."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            lengths = all_rows.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                known = shared.value.get(length)
                for at in range(0, len(own), 1024):
                    batch = all_rows.take(pa.array(own[at : at + 1024]))
                    e = _scaled(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, length))
                    main, held = places(e, known, threshold, whole) if known is not None else (np.zeros(len(e), int), np.ones((len(e), 1), bool))
                    row, cluster = np.nonzero(held)
                    vectors = pa.FixedSizeListArray.from_arrays(pa.array(e[row].reshape(-1)), length).cast(pa.list_(pa.float64()))
                    took = pa.array(row)
                    arrays = [pa.array(cluster + length * _LENGTH), pa.array(main[row] == cluster), batch.column(0).take(took), batch.column(1).take(took), vectors]
                    yield pa.RecordBatch.from_arrays(arrays, ["cluster", "main", "node", "n", "e"])

    return nodes.select("node", "n", "e").mapInArrow(run, _PLACED)


def _unit(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(float)


def _centres(nodes: DataFrame, threshold: float, whole: bool) -> dict[int, np.ndarray]:
    """Centres by vector length, fitted on a bounded sample of the nodes (node, n, e)."""
    totals = {r[0]: r[1] for r in nodes.groupBy(F.size("e")).count().collect()}  # a row for each length
    most = sum(totals.values())
    wide = sum(length * n for length, n in totals.items()) / max(most, 1)
    wanted = max(CENTRE_SAMPLE, 16 * min(MOST_CENTRES, most // SHARD))
    drawn: dict[int, list] = {}
    for r in sampled(nodes.select("node", "e"), F.col("node"), most, int(min(wanted, SAMPLE_BYTES / (8 * max(wide, 1))))).collect():
        drawn.setdefault(len(r.e), []).append((r.node, r.e))
    found = {}
    for length, own in drawn.items():
        own.sort()
        k = max(1, min(MOST_CENTRES, totals[length] // SHARD, len(own) // 8))
        found[length] = choose_centres(_scaled(np.array([e for _, e in own], float)), k, totals[length], threshold, whole)
    return found


def _dealt(nodes: DataFrame, threshold: float, whole: bool = False) -> DataFrame:
    """Nodes by shard: cluster, p, q, part, main, node, n, e. A shard is a cluster, or two parts of one that is too large for a task."""
    placed = materialize(_place(nodes, _centres(nodes, threshold, whole), threshold, whole), "dup-places")
    large = placed.groupBy("cluster").count().filter(F.col("count") > PART)  # at most MOST_CENTRES rows for each length
    large = large.select("cluster", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(large), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).select("cluster", "p", "q", "part", "main", "node", "n", "e")


def _links(dealt: DataFrame, threshold: float, by_graph: bool = True) -> DataFrame:
    """kind, a, b, n: links among nodes by shard.

    kind 0: node a has n rows linked to it inside its cluster; 1: a pair of a cluster's spanning forest; 2: a link across clusters.
    """

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        ids, x = shard["node"].to_numpy(), _unit(shard["e"])
        near = adjacency(x)
        return pd.DataFrame({"node": ids, "near": [ids[r[r >= 0]] for r in near]})

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("node", ignore_index=True)
        ids, n, x = shard["node"].to_numpy(), shard["n"].to_numpy(), _unit(shard["e"])
        main, part, split = shard["main"].to_numpy(bool), shard["part"].to_numpy(), shard["p"].iloc[0] != shard["q"].iloc[0]
        graph = []
        for row, near in enumerate(shard["near"] if by_graph else ()):
            near = np.asarray(near if near is not None else [], np.int64)
            at = np.searchsorted(ids, near).clip(max=len(ids) - 1)
            graph.append(_cut(x, row, at[ids[at] == near]))
        asked = np.flatnonzero(main)
        counts, inside, across = np.zeros(len(ids), np.int64), [], []
        for a, b in range_search(x, graph, asked, threshold) if by_graph else exhaustive(x, asked, threshold):
            fresh = part[a] != part[b] if split else np.ones(len(a), bool)  # a pair within a part is another shard's
            a, b = a[fresh], b[fresh]
            both = main[b]
            inside.append(np.stack([a[both], b[both]]))
            across.append(np.stack([a[~both], b[~both]]))
        empty = np.zeros((2, 0), int)
        # a link that only one side's walk reached counts for both
        i, j = np.concatenate([empty, *inside], axis=1)
        flat = np.unique(np.minimum(i, j) * len(ids) + np.maximum(i, j))
        i, j = flat // len(ids), flat % len(ids)
        np.add.at(counts, i, n[j])
        np.add.at(counts, j, n[i])
        tied, to = _forest(ids, i, j) if len(i) else (ids[:0], ids[:0])
        ca, cb = np.concatenate([empty, *across], axis=1)
        linked = np.flatnonzero(counts)
        return pd.concat([
            pd.DataFrame({"kind": 0, "a": ids[linked], "b": ids[linked], "n": counts[linked]}),
            pd.DataFrame({"kind": 1, "a": tied, "b": to, "n": 0}),
            pd.DataFrame({"kind": 2, "a": np.minimum(ids[ca], ids[cb]), "b": np.maximum(ids[ca], ids[cb]), "n": 0}),
        ], ignore_index=True).astype("int64")

    if not by_graph:
        return dealt.groupBy("cluster", "p", "q").applyInPandas(search, "kind long, a long, b long, n long")
    lists = dealt.groupBy("cluster", "p", "q").applyInPandas(build, "node long, near array<long>")
    # a node is in few shards, each with a list of bounded length
    united = materialize(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "dup-graph")
    return dealt.join(united, "node", "left").groupBy("cluster", "p", "q").applyInPandas(search, "kind long, a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    e = F.transform(as_double(F.col("embedding")), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
    good = usable(F.col("e")) & F.exists("e", lambda x: x != 0)
    rows = rows.withColumn("e", F.when(good, F.col("e")))
    named = rows.filter(F.col("e").isNotNull() & F.col("vec_id").isNotNull())
    nodes = named.groupBy("e").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "dup-nodes")  # ids may have several vectors
    found = _classes(rows, named, nodes, materialize(_links(_dealt(nodes, threshold), threshold), "dup-links"))
    true, counted = audit(vectors, found, threshold)
    _log.info("audit: %d of %d links found", counted, true)
    if counted < LEAST_RECALL * true:
        _log.warning("recall %.3f is below %.2f: shards are searched exhaustively", counted / true, LEAST_RECALL)
        found = _classes(rows, named, nodes, materialize(_links(_dealt(nodes, threshold, True), threshold, by_graph=False), "dup-links"))
    return found


def _classes(rows: DataFrame, named: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row from the links among nodes, as a table."""
    crossing = found.filter("kind = 2").select("a", "b").distinct()
    both = crossing.unionByName(crossing.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = nodes.select(F.col("node").alias("b"), "n")
    counted = found.filter("kind = 0").select("a", "n").unionByName(both.join(weights, "b").select("a", "n"))
    counted = counted.groupBy("a").agg(F.sum("n").alias("links"))
    tied = components(found.filter("kind > 0").select("a", "b"))
    full = nodes.join(counted, F.col("node") == F.col("a"), "left").drop("a").join(tied, "node", "left")
    full = materialize(full.select("e", "n", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root")), "dup-roots")
    least = full.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("class_nodes"))
    full = attach(full, least, "root", "class_nodes", nodes.count()).select("e", "n", "links", "component_id")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    joined = attach(named, materialize(full, "dup-full"), "e", "n", total).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.filter(F.col("e").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return materialize(every, "dup-classes")


def audit(vectors: DataFrame, found: DataFrame, threshold: float = THRESHOLD, most: int = AUDITED) -> tuple[int, int]:
    """Links of a bounded sample of rows that brute force finds, and how many of them near_duplicates() counted."""
    e = as_double(F.col("embedding"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter(usable(F.col("e")) & F.exists("e", lambda x: x != 0))
    asked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toPandas()
    if not len(asked):
        return 0, 0
    own = [_scaled(np.asarray(x, float)[None])[0] for x in asked["e"]]
    ids = asked["vec_id"].tolist()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums, lengths = np.zeros(len(own), np.int64), frame["e"].map(len).to_numpy()
            for length in {len(x) for x in own} & set(lengths.tolist()):
                v = _scaled(np.stack(frame["e"].to_numpy()[lengths == length]).astype(float))
                mine = [i for i, x in enumerate(own) if len(x) == length]
                sums[mine] += (v @ np.stack([own[i] for i in mine]).T >= threshold).sum(0)
            yield pd.DataFrame({"vec_id": ids, "true_links": sums})

    true = rows.mapInPandas(run, "vec_id long, true_links long").groupBy("vec_id").agg((F.sum("true_links") - 1).alias("true_links"))
    got = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum("true_links"), F.sum(F.least("true_links", "n_links"))).first()
    return got[0] or 0, got[1] or 0
