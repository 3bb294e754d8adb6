"""Exact nearest neighbours: blocks of queries against blocks of a corpus, partial top-k by block, then the final one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantorium.functions.encoder import Encode, encode_column
from cantorium.session import spread

QUERY_BLOCK, CORPUS_BLOCK = 2048, 32_768
#: Queries whose cosines with a corpus block a task holds at a time.
ROWS = 64
#: Queries and components of their vectors that every task holds; more queries meet the corpus by blocks.
MOST_QUERIES, MOST_COMPONENTS = 4096, 4 << 20
#: Cosines that a task holds at a time, and pairs that wait to be put in order.
CELLS, WAITING = 1 << 18, 1 << 18


class Copies:
    """The different texts of a column, and the rows that have each of them."""

    def __init__(self, column: pa.Array):
        coded = column.dictionary_encode(null_encoding="encode")
        self.texts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.rows, self.many = np.argsort(code, kind="stable"), np.bincount(code, minlength=len(self.texts))
        self.begin = np.cumsum(self.many) - self.many

    def all(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places of texts, repeated: which of these places, and each of its rows."""
        many = self.many[text]
        of = np.repeat(np.arange(len(text)), many)
        return of, self.rows[self.begin[text][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)]


def reached(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that reach the least ones."""
    return np.divmod(np.flatnonzero(scores >= least), scores.shape[1])


class Best:
    """The k best of the pairs (query's place, id, score) that are added, ties to smaller ids; least: the score that a query's next pair must reach."""

    def __init__(self, queries: int, k: int, kind: type):
        lowest = -np.inf if np.issubdtype(kind, np.floating) else 0
        self.k, self.least, self.last = k, np.full(queries, lowest, kind), np.full(queries, np.iinfo(np.int64).min)
        self.waiting, self.many = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))], 0

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        able = (scores > self.least[row]) | ((scores == self.least[row]) & (ids < self.last[row]))
        self.waiting.append((row[able], ids[able], scores[able]))
        self.many += int(able.sum())
        if self.many > WAITING:
            self.found()

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, ids, scores = (np.concatenate(x) for x in zip(*self.waiting))
        order = np.lexsort((ids, -scores.astype(np.float64), row))
        row, ids, scores = row[order], ids[order], scores[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == self.k - 1
        self.least[row[full]], self.last[row[full]] = scores[full], ids[full]
        near = place < self.k
        self.waiting, self.many = [(row[near], ids[near], scores[near])], 0
        return self.waiting[0]


def rank_top(found: DataFrame, query: str, candidate: str, score: str, k: int) -> DataFrame:
    """The k best candidates of each query, ties to the smaller candidate."""
    order = Window.partitionBy(query).orderBy(F.desc(score), candidate)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", corpus_id: str = "corpus_id", vector: str = "v", skip_same: bool = False, load: Callable[[], Encode] | None = None) -> DataFrame:
    """query_id, corpus_id, cosine, rank. Both sides carry a vector column; skip_same leaves out equal ids. load: the corpus has a column
    `text` instead, which its encoder turns to vectors where they are met.

    A corpus row is met where it is read, by all queries, and a task hands on k rows a query. Where a task cannot hold the queries, either
    side is dealt into blocks of bounded size; a task then holds one block of each.
    """
    asked = queries.select(F.col(query_id).cast("long"), vector).filter(F.col(vector).isNotNull()).limit(MOST_QUERIES + 1)
    if (held := asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()).n <= MOST_QUERIES and held.n * (held.d or 0) <= MOST_COMPONENTS:
        found = _top_where_read(asked.collect(), corpus.select(F.col(corpus_id).cast("long").alias("j"), F.col("text" if load else vector).alias("v")), k, skip_same, load)
    else:
        corpus = corpus.withColumn(vector, encode_column(F.col("text"), load)) if load else corpus
        found = _top_by_blocks(queries, corpus, k, query_id, corpus_id, vector, skip_same)
    return rank_top(found, "i", "j", "cosine", k).select(F.col("i").alias(query_id), F.col("j").alias(corpus_id), "cosine", "rank")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(lists: pa.Array, dimensions: int) -> np.ndarray:
    if not pc.all(pc.equal(pc.list_value_length(lists), dimensions)).as_py():  # true without rows
        raise ValueError(f"vectors of other than {dimensions} dimensions")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dimensions)


def _top_where_read(asked: list, corpus: DataFrame, k: int, skip_same: bool, load: Callable[[], Encode] | None) -> DataFrame:
    """top_k() for queries that every task holds. Products in single precision, less their error, choose the pairs whose cosines are worked out."""
    schema = "i long, j long, cosine double"
    if not asked:
        return corpus.sparkSession.createDataFrame([], schema)
    sent = corpus.sparkSession.sparkContext.broadcast((np.array([r[0] for r in asked], np.int64), np.array([r[1] for r in asked], np.float64)))  # MOST_COMPONENTS at most

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = sent.value
        x = _unit(x)
        rough, error = x.astype(np.float32), (x.shape[1] + 4) * 2.0**-23
        best, step, encode = Best(len(x), k, np.float64), max(1, CELLS // len(x)), load() if load else None
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), Copies(batch.column(1)) if encode else None
            y = _unit(encode(copies.texts).astype(np.float32).astype(np.float64) if encode else _matrix(batch.column(1), x.shape[1]))
            for at in range(0, len(y), step):
                part = y[at : at + step]
                row, place = reached(rough @ part.astype(np.float32).T, (best.least - error).astype(np.float32)[:, None] - np.float32(error))
                cosine = np.einsum("ij,ij->i", x[row], part[place])
                place += at
                if copies:
                    of, place = copies.all(place)
                    row, cosine = row[of], cosine[of]
                own = ids[place]
                if skip_same:
                    other = names[row] != own
                    row, own, cosine = row[other], own[other], cosine[other]
                best.add(row, own, cosine)
        row, ids, cosine = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids), pa.array(cosine)], ["i", "j", "cosine"])

    rows = corpus.filter(F.col("j").isNotNull()) if load else corpus.filter(F.col("v").isNotNull() & F.col("j").isNotNull())
    return spread(rows).mapInArrow(meet, schema)


def _top_by_blocks(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, corpus_id: str, vector: str, skip_same: bool) -> DataFrame:
    n_q, n_c = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (corpus, CORPUS_BLOCK)))
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    left = queries.select(F.col(query_id).alias("i"), F.col(vector).alias("v"), block(query_id, n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    right = corpus.select(F.col(corpus_id).alias("j"), F.col(vector).alias("v"), block(corpus_id, n_c).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))

    def unit(rows: pd.Series) -> np.ndarray:
        return _unit(np.stack(rows.to_numpy()).astype(np.float64))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"i": [], "j": [], "cosine": []}).astype({"i": "int64", "j": "int64"})
        if not len(q) or not len(c):
            return empty
        c = c.sort_values("j", ignore_index=True)
        x, y, ids = unit(q["v"]), unit(c["v"]), c["j"].to_numpy()
        out = []
        for at in range(0, len(q), ROWS):
            sims = x[at : at + ROWS] @ y.T
            own = q["i"].to_numpy()[at : at + ROWS]
            if skip_same:
                sims[own[:, None] == ids[None]] = -np.inf
            n = sims.shape[1]
            least = np.partition(sims, n - k, axis=1)[:, n - k] if n > k else np.full(len(sims), -np.inf)
            row, place = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
            order = np.lexsort((place, -sims[row, place], row))  # ids ascend with places
            row, place = row[order], place[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, place = row[near], place[near]
            out.append(pd.DataFrame({"i": own[row], "j": ids[place], "cosine": sims[row, place]}))
        return pd.concat(out, ignore_index=True)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(meet, "i long, j long, cosine double")
