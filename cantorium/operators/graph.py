"""Communities of graphs, one a scope: by greedy modularity, or by label propagation where a graph has too many edges for one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantorium.session import materialize

MOST_EDGES = 20_000
#: Most rounds of label propagation.
ROUNDS = 30
#: Nodes whose labels every task holds in label propagation.
MOST_NODES = 4_000_000
#: The class of the nodes without an edge.
LONELY = -1


def greedy_communities(edges: pd.DataFrame) -> dict:
    """Node to community: merge the pair of communities that raises modularity most until none does; ties to the smaller nodes."""
    total = float(edges["weight"].sum())
    own: dict = {}
    between: dict = {}
    degree: dict = {}
    for src, dst, weight in edges[["src", "dst", "weight"]].itertuples(index=False):
        for node in (src, dst):
            own.setdefault(node, [node])
            degree[node] = degree.get(node, 0.0) + weight
        if src != dst:
            a, b = min(src, dst), max(src, dst)
            between[a, b] = between.get((a, b), 0.0) + weight
    while between and total > 0:
        gains = ((w / total - degree[a] * degree[b] / (2 * total * total), a, b) for (a, b), w in between.items())
        gain, a, b = max(gains, key=lambda g: (round(g[0], 12), [-ord(c) for c in str(g[1])] if isinstance(g[1], str) else -g[1], [-ord(c) for c in str(g[2])] if isinstance(g[2], str) else -g[2]))
        if gain <= 1e-12:
            break
        own[a] += own.pop(b)
        degree[a] += degree.pop(b)
        merged: dict = {}
        for (x, y), w in between.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                key = min(x, y), max(x, y)
                merged[key] = merged.get(key, 0.0) + w
        between = merged
    return {node: min(nodes) for nodes in own.values() for node in nodes}


def propagate(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Communities of graphs of any size by label propagation: each round a node takes the label that most of its edges' weight has.

    A node keeps its label where that is among the best, else takes the smallest of the best; rounds end when no label changes. Edges are dealt out
    once, to lists of each node's neighbours; a round reads these beside all labels and hands on those that change. Labels of more nodes
    than a task can hold are joined to the edges instead, with the same result.
    """
    both = edges.select("scope", "src", "dst", "weight").unionByName(edges.select("scope", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = both.groupBy("scope", F.col("src").alias("node")).agg(F.collect_list(F.struct("dst", "weight")).alias("near"))
    near = materialize(near.select(F.col("scope").cast("string").alias("scope"), F.col("node").cast("long").alias("node"), F.col("near.dst").cast("array<long>").alias("dst"), F.col("near.weight").cast("array<double>").alias("weight")), "graph-neighbours")
    if near.count() > MOST_NODES:
        return _by_joins(near.select("scope", F.col("node").alias("src"), F.inline(F.arrays_zip("dst", "weight"))), rounds)
    spark = near.sparkSession
    told = near.select("scope", "node").toArrow().sort_by([("scope", "ascending"), ("node", "ascending")])  # MOST_NODES at most
    nodes, scopes = told.column("node").to_numpy(), told.column("scope").combine_chunks().dictionary_encode()
    codes = scopes.indices.to_numpy()
    spans = {name: (int(np.searchsorted(codes, code)), int(np.searchsorted(codes, code, "right"))) for code, name in enumerate(scopes.dictionary.to_pylist())}
    labels = nodes.copy()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((spans, nodes, labels))
        changed = near.mapInArrow(_votes(sent), "place long, community long").toArrow()
        sent.destroy()
        if not changed.num_rows:
            break
        labels = labels.copy()
        labels[changed.column("place").to_numpy()] = changed.column("community").to_numpy()
    for begin, end in spans.values():
        _, first, of = np.unique(labels[begin:end], return_index=True, return_inverse=True)
        labels[begin:end] = nodes[begin:end][first][of]  # nodes ascend
    return spark.createDataFrame(told.append_column("community", pa.array(labels)))


def _votes(sent: Broadcast) -> Callable:
    """A round over lists of neighbours: the places of the nodes whose label changes, with the new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, nodes, labels = sent.value
        for batch in batches:
            places, found = [], []
            ends, dst, weight = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            starts = batch.column(3).offsets.to_numpy()
            for row, (scope, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                begin, end = spans[scope]
                own = nodes[begin:end]
                place = begin + int(np.searchsorted(own, node))
                heard = labels[begin + np.searchsorted(own, dst[ends[row] : ends[row + 1]])]
                order = np.argsort(heard, kind="stable")
                heard = heard[order]
                at = np.flatnonzero(np.concatenate([[True], heard[1:] != heard[:-1]]))
                votes = np.round(np.add.reduceat(weight[starts[row] : starts[row + 1]][order], at), 9)
                best = heard[at][votes == votes.max()]
                if labels[place] not in best:
                    places.append(place)
                    found.append(int(best[0]))  # the smallest
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(found, pa.int64())], ["place", "community"])

    return run


def _by_joins(both: DataFrame, rounds: int) -> DataFrame:
    """propagate() by joins of edges, given both ways, and labels."""
    labels = both.select("scope", F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        heard = both.join(labels.select("scope", F.col("node").alias("dst"), "community"), ["scope", "dst"])
        votes = heard.groupBy("scope", F.col("src").alias("node"), "community").agg(F.sum("weight").alias("votes"))
        own = labels.withColumnRenamed("community", "own")
        judged = votes.join(own, ["scope", "node"]).groupBy("scope", "node", "own")
        best = judged.agg(F.max(F.struct(F.round("votes", 9), (F.col("community") == F.col("own")).alias("kept"), (-F.col("community")).alias("less"))).alias("b"))
        labels = materialize(best.select("scope", "node", "own", (-F.col("b.less")).alias("community")), "graph-labels")
        changed = labels.filter("community <> own").limit(1).count()
        labels = labels.drop("own")
        if not changed:
            break
    least = labels.groupBy("scope", "community").agg(F.min("node").alias("least"))
    return labels.join(least, ["scope", "community"]).select("scope", "node", F.col("least").alias("community"))


def communities(edge_table: DataFrame, nodes: DataFrame | None = None, most: int = MOST_EDGES) -> DataFrame:
    """scope, node, community (its smallest node) for edges src, dst, weight, scope.

    Scopes of at most `most` edges are split by greedy modularity, larger ones by label propagation. nodes (scope, node): those
    without an edge share one further class in their scope, the community LONELY.
    """

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        found = greedy_communities(edges.sort_values(["src", "dst"]))
        return pd.DataFrame({"scope": edges["scope"].iloc[0], "node": list(found), "community": list(found.values())})

    edge_table = materialize(edge_table.select("scope", "src", "dst", "weight"), "graph-edges")
    sizes = materialize(edge_table.groupBy("scope").count(), "graph-sizes")  # their size is known then, and edges stay where they are if it is small
    small, large = (edge_table.join(sizes.filter(c).select("scope"), "scope") for c in (F.col("count") <= most, F.col("count") > most))
    found = small.groupBy("scope").applyInPandas(run, "scope string, node long, community long")
    if not sizes.filter(F.col("count") > most).isEmpty():
        found = found.unionByName(propagate(large))
    if nodes is None:
        return found
    found = materialize(found, "graph-communities")
    lonely = nodes.select("scope", F.col("node").cast("long").alias("node")).distinct().join(found, ["scope", "node"], "left_anti")
    return found.unionByName(lonely.withColumn("community", F.lit(LONELY).cast("long")))
