"""Lexical candidates from an inverted index of character n-grams, merged with semantic ones, and re-ranked by sequence ratio."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantorium.functions.lexical import ratio, seq_ratio
from cantorium.functions.text import char_ngrams, windows
from cantorium.operators.knn import Best, Copies, rank_top, reached
from cantorium.session import materialize


#: Queries, and their distinct n-grams times queries, that every task holds; more are joined through posting lists.
MOST_QUERIES, MOST_CELLS = 8192, 64 << 20
#: Corpus texts that are counted against all queries at a time, and characters of texts that are read at a time.
TEXTS, CHARACTERS = 256, 1 << 16
#: Characters that n-grams leave out.
BLANKS = [ord(c) for c in " \t\n\x0b\f\r\u3000"]


def _grams_of(text: str | None, n: int) -> set[str]:
    bare = re.sub("[ \t\n\x0b\f\r\u3000]+", "", text or "")
    return {bare[i : i + n] for i in range(len(bare) - n + 1)} or ({bare} if bare else set())


class _Numbers:
    """The place of a code among sorted codes, or -1: from a table, or by search where that would be large."""

    def __init__(self, codes: np.ndarray, most: int):
        self.codes, self.table = codes, None
        if most <= 1 << 22:
            self.table = np.full(most, -1, np.int32)
            self.table[codes] = np.arange(len(codes))

    def of(self, asked: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[asked]
        at = np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)
        return np.where(self.codes[at] == asked, at, -1)


class GramIndex:
    """Which known n-grams texts hold; place: n-gram to number. Some `most` texts are read together, by numbers of their beginnings of 1 to n characters."""

    def __init__(self, place: dict[str, int], n: int, most: int):
        self.n, self.place, self.most = n, place, most
        full = [g for g in place if len(g) == n]
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(full))))}
        known = [{g[: k + 1] for g in full} for k in range(n)]
        self.steps, number = [], dict(self.letters)
        for k in range(1, n):
            codes = sorted((number[g[:-1]] * len(self.letters) + self.letters[g[-1]], g) for g in known[k])
            self.steps.append(_Numbers(np.array([c for c, _ in codes], np.int64), len(number) * len(self.letters)))
            number = {g: i for i, (_, g) in enumerate(codes)}
        self.final = np.array([place[g] for g, _ in sorted(number.items(), key=lambda x: x[1])], np.int64)
        self.letter = np.full(max([*map(ord, self.letters), *BLANKS]) + 2, -1, np.int32)  # the last is for all others
        self.letter[list(map(ord, self.letters))] = list(self.letters.values())
        self.letter[BLANKS] = -2

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For pieces of the texts, in order: how many different known n-grams each text holds, and these, text by text."""
        begin, held = 0, 0
        for end, text in enumerate(texts, 1):
            held += len(text or "")
            if held >= CHARACTERS or end - begin == self.most or end == len(texts):
                yield self._piece([t or "" for t in texts[begin:end]])
                begin, held = end, 0

    def _piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        number = self.letter[np.minimum(points, len(self.letter) - 1)]
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        bare = number != -2
        number, owner = number[bare], owner[bare]
        has = np.zeros((len(texts), len(self.place)), bool)
        if self.letters and len(number) >= self.n:
            many = len(number) - self.n + 1
            at, fits = number[:many], (owner[:many] == owner[self.n - 1 :]) & (number[:many] >= 0)
            for k, step in enumerate(self.steps, 1):
                next_one = number[k : k + many]
                at = step.of(np.maximum(at, 0).astype(np.int64) * len(self.letters) + np.maximum(next_one, 0))
                fits &= (next_one >= 0) & (at >= 0)
            has[owner[:many][fits], self.final[at[fits]]] = True
        for row in np.flatnonzero(np.bincount(owner, minlength=len(texts)) < self.n).tolist():  # shorter texts are one n-gram
            for g in _grams_of(texts[row], self.n):
                if g in self.place:
                    has[row, self.place[g]] = True
        row, known = np.divmod(np.flatnonzero(has), max(1, has.shape[1]))
        return np.bincount(row, minlength=len(texts)), known


def ngram_candidates(queries: DataFrame, corpus: DataFrame, k: int, n: int = 2, frequent: float | None = None) -> DataFrame:
    """The k corpus texts that share most distinct n-grams with each query (query_id, corpus_id, shared, rank).

    A corpus text is met where it is read: the rows of its n-grams, which tell the queries that hold them, are added up to what
    it shares with every query, and each task hands on k texts a query. More queries than a task can hold are joined
    through posting lists instead, with the same result. frequent: leave out n-grams that more than this share of the corpus
    holds; None keeps all.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "text").limit(MOST_QUERIES + 1).collect()
    grams = {r.query_id: _grams_of(r.text, n) for r in asked}
    place = {g: i for i, g in enumerate(sorted(set().union(*grams.values())))}
    if len(asked) > MOST_QUERIES or len(grams) < len(asked) or len(place) * len(asked) > MOST_CELLS:
        return _by_postings(queries, corpus, k, n, frequent)
    ids = sorted(grams)
    kind = np.uint8 if max(map(len, grams.values()), default=0) < 256 else np.uint16 if max(map(len, grams.values())) < 65_536 else np.uint32
    holds = np.zeros((len(place), len(ids)), kind)
    for column, i in enumerate(ids):
        holds[[place[g] for g in grams[i]], column] = 1
    texts = corpus.select(F.col("corpus_id").cast("long").alias("corpus_id"), F.col("text").cast("string").alias("text"))
    context = corpus.sparkSession.sparkContext

    index = GramIndex(place, n, TEXTS)

    if frequent is not None and place:
        sent_index = context.broadcast(index)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, rows = np.zeros(len(place), np.int64), 0
            for batch in batches:
                for _, known in sent_index.value.of(batch.column(1).to_pylist()):
                    sums += np.bincount(known, minlength=len(sums))
                rows += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums), dtype=np.int32)), pa.array(np.concatenate([[rows], sums]))], ["gram", "n"])

        counts = {r.gram: r.n for r in texts.mapInArrow(spread, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each n-gram
        holds[[g for g, m in counts.items() if g >= 0 and m > frequent * counts[-1]]] = 0
    sent = context.broadcast((index, holds, ids))  # at most MOST_CELLS cells

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, matrix, names = sent.value
        best, rows, shared = Best(len(names), k, matrix.dtype), np.empty_like(matrix), np.zeros((index.most, len(names)), matrix.dtype)
        for batch in batches:
            own, copies, at = batch.column(0).to_numpy(), Copies(batch.column(1)), 0
            for many, known in index.of(copies.texts):
                end = np.cumsum(many).tolist()
                for i, (a, b) in enumerate(zip([0, *end], end)):
                    np.add.reduce(np.take(matrix, known[a:b], 0, rows[: b - a], "clip"), 0, matrix.dtype, shared[i])
                text, row = reached(shared[: len(many)], np.maximum(best.least, 1))
                of, place = copies.all(at + text)
                best.add(row[of], own[place], shared[text, row][of])
                at += len(many)
        row, found, n_shared = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[row]), pa.array(found), pa.array(n_shared.astype(np.int64))], ["query_id", "corpus_id", "shared"])

    found = texts.filter(F.col("corpus_id").isNotNull()).mapInArrow(meet, "query_id long, corpus_id long, shared long")
    return rank_top(found, "query_id", "corpus_id", "shared", k)


def _by_postings(queries: DataFrame, corpus: DataFrame, k: int, n: int, frequent: float | None) -> DataFrame:
    """ngram_candidates() by joining posting lists."""
    q = queries.select("query_id", F.explode(char_ngrams(F.col("text"), n)).alias("gram"))
    c = corpus.select("corpus_id", F.explode(char_ngrams(F.col("text"), n)).alias("gram")).join(q.select("gram").distinct(), "gram", "left_semi")
    if frequent is not None:
        of = corpus.count()
        c = c.join(c.groupBy("gram").count().filter(F.col("count") > frequent * of).select("gram"), "gram", "left_anti")
    shared = q.join(c, "gram").groupBy("query_id", "corpus_id").agg(F.count(F.lit(1)).alias("shared"))
    return rank_top(shared, "query_id", "corpus_id", "shared", k)


def merge_candidates(semantic: DataFrame, lexical: DataFrame, queries: DataFrame, corpus: DataFrame, most: int = 160) -> DataFrame:
    """Semantic candidates first, then lexical ones, without repeats, at most so many; queries without any get the first ones of the corpus."""
    both = semantic.select("query_id", "corpus_id", F.lit(0).alias("source"), "rank").unionByName(lexical.select("query_id", "corpus_id", F.lit(1).alias("source"), "rank"))
    once = both.groupBy("query_id", "corpus_id").agg(F.min(F.struct("source", "rank")).alias("place"))
    order = Window.partitionBy("query_id").orderBy("place", "corpus_id")
    kept = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    first = corpus.select("corpus_id").orderBy("corpus_id").limit(most)
    first = first.withColumn("place", F.row_number().over(Window.orderBy("corpus_id")))
    bare = queries.select("query_id").join(kept.select("query_id").distinct(), "query_id", "left_anti")
    return kept.unionByName(bare.crossJoin(F.broadcast(first)).select("query_id", "corpus_id", "place"))  # `first` has at most `most` rows


def best_by_ratio(text: str | None, ids: list[int], others: list[str | None], k: int) -> list[tuple[float, int]]:
    """The k others with the highest sequence ratio to a text as (ratio, id), ties to smaller ids.

    Lengths, then counts of characters, bound a ratio from above; others are tried in the order of the first bound until it
    is below the k-th best ratio.
    """
    own, top = text or "", []
    counts = Counter(own)
    bounded = sorted(((2 * min(len(own), len(b or "")) / (len(own) + len(b or "") or 1) if own or b else 1.0, i, b or "") for i, b in zip(ids, others)), key=lambda x: (-x[0], x[1]))
    for bound, i, other in bounded:
        least = -top[-1][0] if len(top) == k else -1.0
        if bound < least:
            break
        total = len(own) + len(other)
        if total and 2 * (counts & Counter(other)).total() / total < least:
            continue
        top = sorted([*top, (-ratio(own, other), i)])[:k]
    return [(-r, i) for r, i in top]


#: Ids of candidates that every task holds.
MOST_IDS = 500_000


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k candidates of each query with the highest sequence ratio (query text first). A query's candidates meet in one task, so they should be bounded."""
    tried = materialize(candidates.select("query_id", "corpus_id"), "tried")
    ids = tried.select("corpus_id").distinct()
    corpus = corpus.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "corpus_id", "left_semi")  # before its texts are dealt out
    texts = tried.join(queries.select("query_id", F.col("text").alias("a")), "query_id")
    texts = texts.join(corpus.select("corpus_id", F.col("text").alias("b")), "corpus_id")

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        best = best_by_ratio(group["a"].iloc[0], group["corpus_id"].tolist(), group["b"].tolist(), k)
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "corpus_id": [i for _, i in best], "score": [r for r, _ in best]})

    scored = texts.groupBy("query_id").applyInPandas(judge, "query_id long, corpus_id long, score double")
    return rank_top(scored, "query_id", "corpus_id", "score", k)


#: Pairs that lexical_best() tries at most.
MOST_PAIRS = 10_000_000


def lexical_best(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each query's corpus text with the highest sequence ratio, by trying all MOST_PAIRS pairs at most; see rerank() for more."""
    pairs = queries.count() * corpus.count()
    if pairs > MOST_PAIRS:
        raise ValueError(f"{pairs} pairs; lexical_best() tries at most {MOST_PAIRS}, rerank() takes candidates")
    tried = queries.select("query_id", F.col("text").alias("a")).crossJoin(corpus.select("corpus_id", F.col("text").alias("b")))
    scored = tried.repartition("query_id", "corpus_id").withColumn("score", seq_ratio("a", "b"))
    best = F.max(F.struct("score", (-F.col("corpus_id")).alias("i"))).alias("best")
    return scored.groupBy("query_id").agg(best).select("query_id", (-F.col("best.i")).alias("corpus_id"), F.col("best.score").alias("score"))


def tfidf_pairs(texts: DataFrame, least: float) -> DataFrame:
    """cosine of smoothed TF-IDF over character 1- and 2-grams, for pairs of texts that share a gram (id_a < id_b)."""
    lower = F.lower("text")
    grams = F.concat(_grams(lower, 1), _grams(lower, 2))
    tf = texts.select("id", F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    size = texts.agg(F.count(F.lit(1)).alias("n"))
    weighed = tf.join(df, "gram").crossJoin(F.broadcast(size))  # one row
    weighed = weighed.select("id", "gram", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighed.join(norm, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("w"))
    a, b = (unit.select(F.col("id").alias(f"id_{s}"), "gram", F.col("w").alias(f"w_{s}")) for s in "ab")
    pairs = a.join(b, "gram").filter(F.col("id_a") < F.col("id_b")).groupBy("id_a", "id_b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("cosine"))
    return pairs.filter(F.col("cosine") >= least)


def _grams(text, n: int):
    return F.when(F.length(text) >= n, windows(text, n)).otherwise(F.array().cast("array<string>"))
