"""Exact top-k by integer inner product with pivot-table elimination.

Components become floor(scale * x). The pivot table, written once, holds every vector's distances to many pivots. By the
triangle inequality a query's distance to a candidate is at least the largest difference of their distances to a pivot;
with the vectors' norms that bounds the inner product from above.

Vectors are in the cell of their nearest pivot. The k-th best score of a query among a bounded sample of real candidates
is a score that its results must reach, so a cell whose interval of distances cannot reach it is left out for that query.
A cell is dealt into blocks of bounded size. Queries go to the blocks of the cells that are left; a candidate is in one
block and is never copied. A task holds one block, and reads the queries batch by batch: each scores the candidates in
the order of their bounds until its k-th best score is above the next bound, and hands on at most k rows, so the result is
exact.

Scores are exact whatever their size: sums that floats cannot hold are taken in 64-bit integers or in Python's.

Defined results: vectors that are null, empty, or hold null or non-finite components (also after scaling) are neither
queries nor candidates; null ids neither; repeated rows are separate candidates, and a query is its id, so equal ids give
one query (of the smallest vector) that passes over all of them; a vector of other length counts as padded with zeros; an
empty table gives no rows; further columns of any name are ignored. A score beyond a long is reported as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantorium.llm.rows import sampled
from cantorium.llm.vectors import as_double, usable
from cantorium.session import materialize

SCALE = 1024
PIVOTS = 32
#: Vectors, by hashes of ids, among which pivots are chosen and that give queries the score to reach.
SAMPLE = 4096
#: Most candidates of a block; small tables have smaller blocks, so that all tasks have one.
BLOCK, LEAST_BLOCK = 32_768, 1024
#: Queries whose bounds are computed at a time, and candidates scored at a time.
QUERIES, STEP = 64, 512
#: Vectors with components from here on have no distances that floats can square; all their distances count as 0.
_HUGE = 2.0**480
_LONG = (-(1 << 63), (1 << 63) - 1)


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    least = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(most, len(sample)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of points to pivots (rows by pivots)."""
    return np.stack([np.linalg.norm(points - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.zeros((len(points), 0))


def scores(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of a vector of whole numbers with others, exact: as floats, long integers or Python's integers."""
    reach = float(np.abs(query).max(initial=0)) * float(np.abs(points).max(initial=0)) * max(len(query), 1)
    if reach < 2**52:
        return points @ query
    if reach < 2**62:
        return points.astype(np.int64) @ query.astype(np.int64)
    own = [int(x) for x in query]
    return np.array([sum(int(a) * b for a, b in zip(row, own)) for row in points] + [None], object)[:-1]


def _as_long(score) -> int:
    return min(max(int(score), _LONG[0]), _LONG[1])


def least_wanted(query: np.ndarray, own: int, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> float:
    """The query's k-th best score among the sample, a little less than exact; minus infinity for fewer than k."""
    with np.errstate(over="ignore", invalid="ignore"):
        got = (sample @ query)[sample_ids != own]
    if len(got) < k or not np.isfinite(got).all():
        return -np.inf
    kth = float(np.partition(got, len(got) - k)[len(got) - k])
    return kth - 1e-9 * (abs(kth) + float(np.linalg.norm(query)) * float(np.linalg.norm(sample, axis=1).max())) - 1


def bounds(squares: np.ndarray, query_square: float, apart: np.ndarray) -> np.ndarray:
    """What inner products cannot exceed, from squared norms and least distances; never less for rounding, without limit where floats overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = (query_square + squares - apart**2) / 2
        bound = bound + 1e-9 * (np.abs(bound) + squares + query_square) + 1
    return np.where(np.isnan(bound), np.inf, bound)


def best(queries: np.ndarray, query_ids: np.ndarray, query_far: np.ndarray, least: np.ndarray, points: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query its id and its k best (score, id) among the points that reach `least`, ties to smaller ids. far: distances to pivots."""
    with np.errstate(over="ignore"):
        squares, query_squares = (points**2).sum(1), (queries**2).sum(1)
    for at in range(0, len(queries), QUERIES):
        some = slice(at, at + QUERIES)
        apart = np.zeros((len(queries[some]), len(points)))
        for p in range(far.shape[1]):
            np.maximum(apart, np.abs(query_far[some, p, None] - far[None, :, p]), out=apart)
        bound = bounds(squares[None], query_squares[some, None], apart)
        bound[query_ids[some, None] == ids[None]] = -np.inf
        for query, own, limit, upper in zip(queries[some], query_ids[some].tolist(), least[some].tolist(), bound):
            able = np.flatnonzero((upper >= limit) & (upper > -np.inf))
            order = able[np.argsort(-upper[able], kind="stable")]
            top: list[tuple[int, int]] = []
            for first in range(0, len(order), STEP):
                if len(top) == k and -top[-1][0] > upper[order[first]]:
                    break
                part = order[first : first + STEP]
                got = scores(query, points[part])
                if len(top) == k:
                    near = (got >= -top[-1][0]).astype(bool)
                    part, got = part[near], got[near]
                top = sorted(top + [(-int(s), i) for s, i in zip(got.tolist(), ids[part].tolist())])[:k]
            yield own, [(-s, i) for s, i in top]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of number lists as rows of one length, padded with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(column) and (ends == dims).all():
        return flat.reshape(len(column), dims)
    full = np.zeros((len(column), dims))
    full[np.arange(dims)[None] < ends[:, None]] = flat
    return full


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    scaled = F.transform(as_double(F.col("embedding")), lambda x: F.lit(float(scale)) * x)
    points = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    whole = F.transform("v", lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x))  # larger doubles are whole
    points = materialize(points.select("vec_id", whole.alias("v")), "topk-points")
    dims, rows, top = points.agg(F.max(F.size("v")), F.count(F.lit(1)), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    dims, unit = dims or 1, float((top or 0.0) < _HUGE)
    drawn = sorted(sampled(points, F.struct("vec_id", "v"), rows, SAMPLE).collect(), key=lambda r: (r.vec_id, r.v))
    sample, sample_ids = _matrix(pa.array([r.v for r in drawn], pa.list_(pa.float64())), dims), np.array([r.vec_id for r in drawn], np.int64)
    sent = spark.sparkContext.broadcast((choose_pivots(sample * unit), sample, sample_ids))  # about SAMPLE rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value[0]
        for batch in batches:
            far = distances(_matrix(batch.column(1), dims) * unit, pivots)
            cell = pa.array((far.argmin(1) if far.shape[1] else np.zeros(len(far))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(far), cell], ["vec_id", "v", "far", "cell"])

    table = points.mapInArrow(measure, "vec_id long, v array<double>, far array<double>, cell int").withColumn("row", F.monotonically_increasing_id())
    table = materialize(table, "topk-pivots")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    reach = [f(F.element_at("far", p + 1)).alias(f"{n}{p}") for p in range(len(sent.value[0])) for n, f in (("lo", F.min), ("hi", F.max))]
    cells = {r.cell: r for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square"), *reach).collect()}  # at most PIVOTS rows
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    size = min(BLOCK, max(LEAST_BLOCK, -(-rows // tasks)))
    many = {c: -(-r.n // size) for c, r in cells.items()}
    first, blocks = {}, 0
    for c in sorted(many):
        first[c], blocks = blocks, blocks + many[c]
    order = sorted(cells)
    low = np.array([[cells[c][f"lo{p}"] for p in range(len(sent.value[0]))] for c in order])
    high = np.array([[cells[c][f"hi{p}"] for p in range(len(sent.value[0]))] for c in order])
    largest = np.array([cells[c].square for c in order])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the score to reach, once for each block of the cells that are left."""
        _, sample, sample_ids = sent.value
        spread = [np.arange(first[c], first[c] + many[c]) for c in order]
        for batch in batches:
            ids, v, far = batch.column(0).to_numpy(), _matrix(batch.column(1), dims), _matrix(batch.column(2), low.shape[1])
            least = np.array([least_wanted(q, i, sample, sample_ids, k) for q, i in zip(v, ids.tolist())])
            apart = np.maximum(np.maximum(low[None] - far[:, None], far[:, None] - high[None]), 0).max(2, initial=0)
            with np.errstate(over="ignore"):
                upper = bounds(largest[None], (v**2).sum(1)[:, None], apart)
            for r in range(len(ids)):
                to = np.concatenate([spread[c] for c in np.flatnonzero(upper[r] >= least[r])] or [np.zeros(0, int)])
                took = pa.array(np.full(len(to), r))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.astype(np.int32)), pa.array(np.ones(len(to), bool)), pa.array(np.full(len(to), least[r])), *(batch.column(i).take(took) for i in range(3))],
                    ["block", "asks", "least", "vec_id", "v", "far"],
                )

    columns = "block int, asks boolean, least double, vec_id long, v array<double>, far array<double>"
    asked = table.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "far")).alias("q")).select("vec_id", "q.v", "q.far")
    queries = asked.mapInArrow(route, columns)
    numbers = F.create_map(*[F.lit(x) for c in order for x in (c, first[c])]) if order else F.lit(None).cast("map<int,int>")
    counts = F.create_map(*[F.lit(x) for c in order for x in (c, many[c])]) if order else F.lit(None).cast("map<int,int>")
    block = F.element_at(numbers, F.col("cell")) + F.pmod(F.xxhash64("row"), F.element_at(counts, F.col("cell"))).cast("int")
    candidates = table.select(block.cast("int").alias("block"), F.lit(False).alias("asks"), F.lit(0.0).alias("least"), "vec_id", "v", "far")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, its candidates before its queries."""
        held: list[tuple] = []
        now, ready = None, None
        for whole_batch in batches:
            numbers = whole_batch.column(0).to_numpy()
            asks = whole_batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                if start == end:
                    continue
                batch = whole_batch.slice(start, end - start)
                if numbers[start] != now:
                    now, held, ready = numbers[start], [], None
                part = batch.column(3).to_numpy(), _matrix(batch.column(4), dims), _matrix(batch.column(5), low.shape[1])
                if not asks[start]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = [np.concatenate(x) for x in zip(*held)]
                found = best(part[1], part[0], part[2], batch.column(2).to_numpy(), ready[1], ready[0], ready[2], k)
                rows = [(own, i, _as_long(s)) for own, top in found for s, i in top]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    dealt = candidates.unionByName(queries).repartition("block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(meet, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
