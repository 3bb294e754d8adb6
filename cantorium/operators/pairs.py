"""Pairs of rows inside a group, across groups, and between two corpora; always blocked by a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cantorium.functions import stats
from cantorium.functions.lexical import matched_share, near_tokens, ratio, soft_jaccard
from cantorium.session import MOST_BROADCAST, materialize


def within(df: DataFrame, block: list[str], key: str, columns: list[str], apart: str | None = None) -> DataFrame:
    """Unordered pairs of rows that share a block, as key_a < key_b; apart: a column that must differ."""
    keep = [key, *columns, *([apart] if apart and apart not in columns else [])]
    a = df.select(*block, *[F.col(c).alias(f"{c}_a") for c in keep])
    b = df.select(*block, *[F.col(c).alias(f"{c}_b") for c in keep])
    on = F.col(f"{key}_a") < F.col(f"{key}_b")
    if apart:
        on = on & (F.col(f"{apart}_a") != F.col(f"{apart}_b"))
    return a.join(b, block).filter(on)


def between(left: DataFrame, right: DataFrame, block: list[str]) -> DataFrame:
    """Rows of two corpora that share a block."""
    return left.join(right, block)


#: Rows of a part, and components of its vectors, at most; a block of more than LEAST_PART rows is dealt into up to PARTS parts, so that its meetings
#: spread. A row goes to as many tasks as its block has parts, so large parts keep down what is shuffled.
PART, COMPONENTS, LEAST_PART, PARTS = 65_536, 8 << 20, 1024, 6
#: Rows of a part that meet the other part at a time, cosines held then, and pairs of a batch that leaves a task.
ROWS, CELLS, BATCH = 256, 1 << 22, 1 << 17


class Side:
    """Rows of one part: ids in order, unit vectors, and carried columns."""

    def __init__(self, rows: pa.Table, carry: list[str]):
        vectors = rows.column("__v").combine_chunks()
        lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
        if len(lengths) > 1:
            raise ValueError(f"vectors of {sorted(lengths)} dimensions in one block")
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        ids = rows.column("__id").to_numpy()
        real = np.isfinite(x).all(1)  # others have no cosine
        order = np.flatnonzero(real)[np.argsort(ids[real], kind="stable")]
        self.ids, x = ids[order], x[order]
        self.x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        self.carried = {c: rows.column(c).take(pa.array(order)).to_pylist() for c in carry}


class Meeting:
    """Two parts of a block, or one with itself; every pair is met once."""

    def __init__(self, left: Side, right: Side):
        self.left, self.right = left, right

    def _products(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        step = max(1, min(ROWS, CELLS // max(1, len(self.right.x))))
        for at in range(0, len(self.left.x), step):
            x = self.left.x[at : at + step]
            if self.left is not self.right:
                yield at, 0, x @ self.right.x.T, None
            else:  # rows before `at` have met these already
                yield at, at, x @ self.right.x[at:].T, self.left.ids[at : at + step, None] < self.right.ids[None, at:]

    def values(self) -> Iterator[np.ndarray]:
        """The cosines of all pairs, piece by piece."""
        for _, _, sims, fit in self._products():
            yield sims.ravel() if fit is None else sims[fit]

    def found(self, least: float | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in left and right, and cosines, of the pairs that reach a threshold."""
        for at, to, sims, fit in self._products():
            near = sims >= least
            i, j = np.nonzero(near if fit is None else near & fit)
            yield at + i, to + j, sims[i, j]

    def ordered(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pairs, the smaller one first."""
        a, b = self.left.ids[i], self.right.ids[j]
        return np.minimum(a, b), np.maximum(a, b)


Judge = Callable[[dict, Meeting], Iterator[dict]]


def _judged(rows: DataFrame, block: list[str], carry: list[str], told: list[str], judge: Judge, schema: str, meetings: int) -> DataFrame:
    """judge() of each meeting: rows hold the block, __p and __q (the parts that meet), __side (0, 1, or 2 for both), __id, __v, carried and told columns."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*block).schema.fields) if block else ""
    schema = f"{kinds}{', ' if kinds else ''}{schema}"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        first = table.slice(0, 1)
        own = {c: first.column(c)[0] for c in (*block, *told)}
        side = table.column("__side").to_numpy()
        if side[0] == 2:
            left = right = Side(table, carry)
        else:
            left, right = (Side(table.filter(pa.array(side == s)), carry) for s in (0, 1))
        del table
        if not len(left.ids) or not len(right.ids):
            return
        for found in judge({c: own[c].as_py() for c in own}, Meeting(left, right)):
            many = len(next(iter(found.values())))
            for at in range(0, many, BATCH):
                n = min(BATCH, many - at)
                columns = [pa.repeat(own[f.name], n) if f.name in block else pa.array(found[f.name][at : at + n], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    keys = [*block, "__p", "__q"]
    spark = rows.sparkSession
    tasks = 16 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(max(1, min(meetings, tasks)), *keys).groupBy(*keys).applyInArrow(run, schema)


def _ready(df: DataFrame, block: list[str], key: str, vector: str | None, more: list[str]) -> DataFrame:
    v = F.array(F.lit(0.0)) if vector is None else F.col(vector)
    rows = df.select(*block, F.col(key).cast("long").alias("__id"), v.alias("__v"), *more).filter(F.col("__v").isNotNull() & F.col("__id").isNotNull())
    for b in block:
        rows = rows.filter(F.col(b).isNotNull())
    return rows


def _parts(part: int) -> Column:
    size = F.count(F.lit(1))
    most = F.greatest(F.least(F.lit(part), F.floor(F.lit(COMPONENTS) / F.greatest(F.max(F.size("__v")), F.lit(1)))), F.lit(1))
    return F.greatest(F.ceil(size / most), F.least(F.ceil(size / LEAST_PART), F.lit(PARTS)), F.lit(1)).cast("int")


def _with_parts(rows: DataFrame, many: DataFrame, block: list[str], blocks: int) -> DataFrame:
    if not block:
        return rows.crossJoin(F.broadcast(many))  # one row
    return rows.join(F.broadcast(many) if blocks <= MOST_BROADCAST else many, block)


def _all(name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(name) - 1))


def _part(name: str) -> Column:
    return F.pmod(F.xxhash64("__id"), F.col(name)).cast("int")


def met(df: DataFrame, block: list[str], key: str, vector: str | None, judge: Judge, schema: str, carry: list[str] | None = None, told: list[str] | None = None, part: int | None = None) -> DataFrame:
    """What judge() yields, as columns of `schema` after the block's, of all pairs of different keys in a block (or of all rows, without one).

    A block of many rows is dealt into parts; every two parts, and each part with itself, meet in a task by matrix products, so a task
    holds two parts and a few of their rows' cosines. carry: columns that judge() finds at the sides; told: columns that are one in a block. vector: None where
    only carried columns count.
    """
    carry, told = carry or [], told or []
    rows = _ready(df, block, key, vector, [*carry, *told])
    many = rows.groupBy(*block).agg(_parts(part or PART).alias("__parts"))
    shape = many.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.expr("__parts * (__parts + 1) div 2")).alias("meetings")).first()
    rows = _with_parts(rows, many, block, shape.blocks).withColumn("__part", _part("__parts")).withColumn("__other", _all("__parts"))
    rows = rows.withColumns({"__p": F.least("__part", "__other"), "__q": F.greatest("__part", "__other")})
    rows = rows.withColumn("__side", F.when(F.col("__p") == F.col("__q"), 2).when(F.col("__part") == F.col("__p"), 0).otherwise(1)).drop("__parts", "__part", "__other")
    return _judged(rows, block, carry, told, judge, schema, shape.meetings or 1)


def cosine_between(left: DataFrame, right: DataFrame, block: list[str], left_key: str, right_key: str, vector: str, least: float) -> DataFrame:
    """Pairs of a row of one corpus and one of another in a block, with their cosine, at least a threshold; parts meet as in met()."""
    a, b = _ready(left, block, left_key, vector, []), _ready(right, block, right_key, vector, [])
    many = a.groupBy(*block).agg(_parts(PART).alias("__m")).join(b.groupBy(*block).agg(_parts(PART).alias("__n")), block)
    shape = many.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.expr("__m * __n")).alias("meetings")).first()
    a = _with_parts(a, many, block, shape.blocks).withColumns({"__p": _part("__m"), "__side": F.lit(0)}).withColumn("__q", _all("__n"))
    b = _with_parts(b, many, block, shape.blocks).withColumns({"__q": _part("__n"), "__side": F.lit(1)}).withColumn("__p", _all("__m"))

    def judge(_: dict, meeting: Meeting) -> Iterator[dict]:
        for i, j, cosine in meeting.found(least):
            yield {left_key: meeting.left.ids[i], right_key: meeting.right.ids[j], "cosine": cosine}

    rows = a.drop("__m", "__n").unionByName(b.drop("__m", "__n"))
    return _judged(rows, block, [], [], judge, f"`{left_key}` long, `{right_key}` long, cosine double", shape.meetings or 1)


def cosine_pairs(df: DataFrame, block: list[str], key: str, vector: str, least: float | None = None) -> DataFrame:
    """Pairs in a block (or of all rows, without one) with their cosine, at least a threshold; only these leave a task."""
    floor = -np.inf if least is None else least

    def judge(_: dict, meeting: Meeting) -> Iterator[dict]:
        for i, j, cosine in meeting.found(floor):
            a, b = meeting.ordered(i, j)
            yield {f"{key}_a": a, f"{key}_b": b, "cosine": cosine}

    return met(df, block, key, vector, judge, f"`{key}_a` long, `{key}_b` long, cosine double")


#: Rows of a part that carries texts, of one of which all pairs of texts are compared, and of one that carries token sets.
TEXT_PART, TURNS, TOKEN_PART = 4096, 128, 512
#: Token sets whose pairs are compared one by one.
FEW = 16


def hidden_pairs(df: DataFrame, block: list[str], key: str, vector: str, text: str, least: float, most: float) -> DataFrame:
    """Pairs in a block with a cosine of at least `least` and a sequence ratio (smaller key first) of at most `most`; texts go with their rows, not with pairs."""

    def judge(_: dict, meeting: Meeting) -> Iterator[dict]:
        texts, others = meeting.left.carried[text], meeting.right.carried[text]
        for i, j, cosine in meeting.found(least):
            first = meeting.left.ids[i] < meeting.right.ids[j]
            order = np.lexsort((np.where(first, j, i), first))  # pairs of one second text one after the other
            lexical = np.empty(len(i))
            for at in order.tolist():
                x, y = texts[i[at]], others[j[at]]
                lexical[at] = ratio(x, y) if first[at] else ratio(y, x)
            kept = lexical <= most
            a, b = meeting.ordered(i[kept], j[kept])
            yield {f"{key}_a": a, f"{key}_b": b, "cosine": cosine[kept], "lexical": lexical[kept]}

    return met(df, block, key, vector, judge, f"`{key}_a` long, `{key}_b` long, cosine double, lexical double", carry=[text], part=TEXT_PART)


def text_measures(df: DataFrame, block: list[str], key: str, vector: str, text: str) -> DataFrame:
    """Pairs in a block, with mean and maximum of their cosines (sem) and sequence ratios (lex, smaller key first); a task hands on a row for each block."""

    def judge(_: dict, meeting: Meeting) -> Iterator[dict]:
        texts, others = meeting.left.carried[text], meeting.right.carried[text]
        n, sums, most = 0, np.zeros(2), np.full(2, -np.inf)
        for i, j, sem in meeting.found(-np.inf):
            if not len(i):
                continue
            first = meeting.left.ids[i] < meeting.right.ids[j]
            lex = np.empty(len(i))
            for at in np.lexsort((np.where(first, j, i), first)).tolist():
                x, y = texts[i[at]], others[j[at]]
                lex[at] = ratio(x, y) if first[at] else ratio(y, x)
            n, sums, most = n + len(i), sums + [sem.sum(), lex.sum()], np.maximum(most, [sem.max(), lex.max()])
        if n:
            yield {"n": [n], "sum_sem": sums[:1], "sum_lex": sums[1:], "max_sem": most[:1], "max_lex": most[1:]}

    found = met(df, block, key, vector, judge, "n long, sum_sem double, sum_lex double, max_sem double, max_lex double", carry=[text], part=TURNS)
    n = F.sum("n")
    means = [(F.sum(f"sum_{c}") / n).alias(f"avg_{c}") for c in ("sem", "lex")]
    return found.groupBy(*block).agg(n.alias("pairs"), *means, *[F.max(f"max_{c}").alias(f"max_{c}") for c in ("sem", "lex")])


def soft_jaccard_pairs(df: DataFrame, block: list[str], key: str, tokens: str) -> DataFrame:
    """pairs in a block with the soft Jaccard of their token sets (smaller key first); which tokens are near is found once for all pairs of two parts."""

    def judge(_: dict, meeting: Meeting) -> Iterator[dict]:
        left, right = ([sorted(set(t if t is not None else ())) for t in side.carried[tokens]] for side in (meeting.left, meeting.right))
        if max(len(left), len(right)) <= FEW:
            for i, j, _cosine in meeting.found(-np.inf):
                first = meeting.left.ids[i] < meeting.right.ids[j]
                a, b = meeting.ordered(i, j)
                found = [soft_jaccard(left[x], right[y]) if f else soft_jaccard(right[y], left[x]) for x, y, f in zip(i.tolist(), j.tolist(), first.tolist())]
                yield {f"{key}_a": a, f"{key}_b": b, "similarity": np.array(found, float)}
            return
        words = [sorted(set().union(*side)) for side in (left, right)]
        near = near_tokens(words[0], words[1])
        back = near if meeting.left is meeting.right else near_tokens(words[1], words[0])
        left_sets, right_sets = [set(t) for t in left], [set(t) for t in right]
        for i, j, _cosine in meeting.found(-np.inf):
            first = (meeting.left.ids[i] < meeting.right.ids[j]).tolist()
            pairs = zip(i.tolist(), j.tolist(), first)
            found = [matched_share(left[x], right_sets[y], near) if a else matched_share(right[y], left_sets[x], back) for x, y, a in pairs]
            a, b = meeting.ordered(i, j)
            yield {f"{key}_a": a, f"{key}_b": b, "similarity": np.array(found, float)}

    return met(df, block, key, None, judge, f"`{key}_a` long, `{key}_b` long, similarity double", carry=[tokens], part=TOKEN_PART)


def top_pairs(df: DataFrame, block: list[str], key: str, vector: str, most: int) -> DataFrame:
    """Pairs in a block with their cosine, of which each task hands on the `most` strongest (ties to smaller keys); the strongest of all are among them."""

    def judge(_: dict, meeting: Meeting) -> Iterator[dict]:
        a, b, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(1, -np.inf)  # rises while the pairs are met
        for i, j, cosine in meeting.found(floor):
            if len(cosine) > most:
                near = cosine >= np.partition(cosine, len(cosine) - most)[len(cosine) - most]
                i, j, cosine = i[near], j[near], cosine[near]
            x, y = meeting.ordered(i, j)
            a, b, best = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([best, cosine])
            order = np.lexsort((b, a, -best))[:most]
            a, b, best = a[order], b[order], best[order]
            if len(best) == most:
                floor[0] = best[-1]
        yield {f"{key}_a": a, f"{key}_b": b, "cosine": best}

    return met(df, block, key, vector, judge, f"`{key}_a` long, `{key}_b` long, cosine double")


def cosine_statistics(df: DataFrame, block: list[str], key: str, vector: str, threshold: float) -> DataFrame:
    """pair_statistics() of all pairs' cosines in a block: a task hands on a row."""

    def judge(_: dict, meeting: Meeting) -> Iterator[dict]:
        n, total, most, low, high = 0, 0.0, -np.inf, np.inf, 0
        for v in meeting.values():
            if len(v):
                n, total, most, low, high = n + len(v), total + float(v.sum()), max(most, float(v.max())), min(low, float(v.min())), high + int((v >= threshold).sum())
        if n:
            yield {"n": [n], "total": [total], "most": [most], "least": [low], "high": [high]}

    found = met(df, block, key, vector, judge, "n long, total double, most double, least double, high long").groupBy(*block)
    n = F.sum("n")
    return found.agg(n.alias("pairs"), (F.sum("total") / n).alias("mean"), F.max("most").alias("most"), F.min("least").alias("least"), (F.sum("high") / n).alias("high_share"))


def tally(df: DataFrame, block: list[str], key: str, vector: str, code: Callable[[np.ndarray], np.ndarray], low: int, high: int) -> DataFrame:
    """How many pairs of a block have which code (code, n): code() gives integers from low to high for cosines; a task hands on a row for each code."""

    def judge(_: dict, meeting: Meeting) -> Iterator[dict]:
        counts = np.zeros(high - low + 1, np.int64)
        for v in meeting.values():
            counts += np.bincount(np.clip(code(v), low, high) - low, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield {"code": seen + low, "n": counts[seen]}

    return met(df, block, key, vector, judge, "code long, n long").groupBy(*block, "code").agg(F.sum("n").alias("n"))


#: Bins of a level of cosine_cuts() are 2^-LEVEL as wide as those before; the intervals of all blocks together may hold so many values.
LEVEL, MOST_VALUES = 12, 2_000_000


def cosine_cuts(df: DataFrame, block: list[str], key: str, vector: str, cuts: list[float], high: float) -> DataFrame:
    """Of all pairs' cosines in a block the number, percentiles (linear, exact; p0, p1, ...) and the share at or above a threshold.

    Cosines are counted by bins, then by finer bins inside those that hold the asked ranks, until these hold few values, which are
    then sorted; every pass meets all pairs again, and no task holds or hands on more than bins and those values.
    """

    def bins(v: np.ndarray, level: int) -> np.ndarray:
        return np.maximum(np.floor((v + 1.0) * float(1 << (LEVEL * level - 1))).astype(np.int64), 0)

    def first(_: dict, meeting: Meeting) -> Iterator[dict]:
        counts, reach = np.zeros((1 << LEVEL) + 1, np.int64), 0
        for v in meeting.values():
            counts += np.bincount(bins(v, 1), minlength=len(counts))
            reach += int((v >= high).sum())
        seen = np.flatnonzero(counts)
        if len(seen):
            yield {"bin": np.append(seen, -1), "n": np.append(counts[seen], reach)}

    def finer(level: int) -> Judge:
        def judge(own: dict, meeting: Meeting) -> Iterator[dict]:
            wide = 1 << LEVEL
            parents = np.unique(np.array(own["__bins"], np.int64))
            counts = np.zeros((len(parents), wide), np.int64)
            for v in meeting.values():
                b = bins(v, level)
                at = np.minimum(np.searchsorted(parents, b >> LEVEL), len(parents) - 1)
                inside = parents[at] == b >> LEVEL
                counts += np.bincount(at[inside] * wide + (b[inside] & (wide - 1)), minlength=counts.size).reshape(counts.shape)
            row, low = np.nonzero(counts)
            if len(row):
                yield {"bin": parents[row] * wide + low, "n": counts[row, low]}

        return judge

    def values(level: int) -> Judge:
        def judge(own: dict, meeting: Meeting) -> Iterator[dict]:
            kept = [v[np.isin(bins(v, level), own["__bins"])] for v in meeting.values()]
            v, n = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0), np.zeros(0, np.int64))
            if len(v):
                yield {"value": v, "n": n}

        return judge

    def ranked(counted: DataFrame, value: str, asked: DataFrame) -> DataFrame:
        """asked (block, rank, skipped) with the value that holds each rank, how many come before, and how many hold it."""
        own = Window.partitionBy(*block, "outer").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        told = counted.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
        end = F.max(F.col("before") + F.col("n")).over(Window.partitionBy(*block, "outer"))
        told = told.withColumn("last", F.col("before") + F.col("n") == end)
        joined = asked.join(told, [*block, "outer"])
        left = F.col("rank") - F.col("skipped")
        return joined.filter((left >= F.col("before")) & ((left < F.col("before") + F.col("n")) | F.col("last")))

    counted = materialize(met(df, block, key, vector, first, "bin long, n long").groupBy(*block, "bin").agg(F.sum("n").alias("n")), "cosine-bins")
    sizes = counted.groupBy(*block).agg(F.sum(F.when(F.col("bin") >= 0, F.col("n")).otherwise(0)).alias("pairs"), F.sum(F.when(F.col("bin") < 0, F.col("n")).otherwise(0)).alias("reach"))
    spots = F.array(*[F.struct(F.lit(i).alias("cut"), ((F.col("pairs") - 1) * F.lit(c / 100)).alias("spot")) for i, c in enumerate(cuts)])
    wanted = sizes.select(*block, F.explode(spots).alias("s")).select(*block, "s.cut", "s.spot")
    wanted = wanted.select(*block, "cut", "spot", F.explode(F.array(F.floor("spot"), F.ceil("spot"))).alias("rank"))
    asked = wanted.select(*block, "rank").distinct().withColumns({"outer": F.lit(0).cast("long"), "skipped": F.lit(0).cast("long")})
    counted, level = counted.filter("bin >= 0").withColumn("outer", F.lit(0).cast("long")), 1
    while True:
        found = materialize(ranked(counted, "bin", asked).select(*block, "rank", F.col("bin").alias("outer"), (F.col("skipped") + F.col("before")).alias("skipped"), "n"), "cosine-ranks")
        held = found.select(*block, "outer", "n").distinct().agg(F.sum("n").alias("n")).first().n or 0
        asked, targets = found.drop("n"), found.groupBy(*block).agg(F.collect_set("outer").alias("__bins"))
        aimed = df.join(F.broadcast(targets), block) if found.count() <= MOST_BROADCAST else df.join(targets, block)
        if held <= MOST_VALUES or level == 4:
            break
        level += 1
        counted = met(aimed, block, key, vector, finer(level), "bin long, n long", told=["__bins"]).groupBy(*block, "bin").agg(F.sum("n").alias("n"))
        counted = materialize(counted.withColumn("outer", F.shiftright("bin", LEVEL)), "cosine-bins")
    counted = met(aimed, block, key, vector, values(level), "value double, n long", told=["__bins"]).groupBy(*block, "value").agg(F.sum("n").alias("n"))
    scale = float(1 << (LEVEL * level - 1))
    counted = counted.withColumn("outer", F.greatest(F.floor((F.col("value") + 1.0) * scale), F.lit(0)).cast("long"))
    exact = ranked(counted, "value", asked).select(*block, "rank", "value")
    ends = wanted.join(exact, [*block, "rank"]).groupBy(*block, "cut", "spot").agg(F.min(F.struct("rank", "value")).alias("a"), F.max(F.struct("rank", "value")).alias("b"))
    between = F.col("a.value") + (F.col("spot") - F.floor("spot")) * (F.col("b.value") - F.col("a.value"))
    percentiles = ends.groupBy(*block).agg(*[F.max(F.when(F.col("cut") == i, between)).alias(f"p{i}") for i in range(len(cuts))])
    return sizes.join(percentiles, block).select(*block, "pairs", *[f"p{i}" for i in range(len(cuts))], (F.col("reach") / F.col("pairs")).alias("share"))


def pair_statistics(pairs: DataFrame, groups: list[str], value: str, threshold: float) -> DataFrame:
    """Count, mean, extremes and share at or above a threshold."""
    v = F.col(value)
    return pairs.groupBy(*groups).agg(F.count(F.lit(1)).alias("pairs"), F.avg(v).alias("mean"), F.max(v).alias("most"), F.min(v).alias("least"), stats.share_at_least(v, threshold).alias("high_share"))


def binned_entropy(values: DataFrame, groups: list[str], value: str, bins: int = 20) -> DataFrame:
    """Entropy of the values' bins over [0, 1], over log2(bins)."""
    return _entropy(values.groupBy(*groups, stats.unit_bin(F.col(value), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n")), groups, bins)


def cosine_entropy(df: DataFrame, block: list[str], key: str, vector: str, bins: int = 20) -> DataFrame:
    """binned_entropy() of all pairs' cosines in a block."""
    code = lambda v: np.minimum((v / (1.0 / bins)).astype(np.int64), bins - 1)  # noqa: E731  as stats.unit_bin()
    return _entropy(tally(df, block, key, vector, code, -bins, bins - 1), block, bins)


def _entropy(counts: DataFrame, groups: list[str], bins: int) -> DataFrame:
    return counts.groupBy(*groups).agg((stats.entropy_bits(F.col("n")) / F.log2(F.lit(float(bins)))).alias("binned_entropy"))


def density(df: DataFrame, groups: list[str], key: str, vector: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density of all pairs' cosines on an even grid over [0, 1] with Scott's bandwidth; groups of more than 10 values.

    The cosines are counted at 1e-4 where they are met, so a grid point reads at most that many rows whatever the group's size.
    """

    def code(v: np.ndarray) -> np.ndarray:  # nine decimals, then four, halves away from zero
        fine = np.rint(v * 1e9)
        return (np.sign(fine) * ((np.abs(fine) + 50_000) // 100_000)).astype(np.int64)

    counted = materialize(tally(df, groups, key, vector, code, -10_000, 10_000).select(*groups, (F.col("code") / 10_000.0).alias("v"), F.col("n").alias("c")), "cosine-counts")
    means = counted.groupBy(*groups).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.count(F.lit(1)).alias("different"))
    spread = counted.join(means, groups).groupBy(*groups, "n", "different").agg(F.sqrt(F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), F.lit(2.0))) / (F.col("n") - 1)).alias("sd"))
    spread = spread.filter((F.col("n") > 10) & (F.col("different") > 1)).withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    grid = counted.join(spread, groups).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("i") / float(points - 1))
    bump = F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), F.lit(2.0))) * F.col("c") / (F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5)
    return grid.groupBy(*groups, "x").agg(F.sum(bump).alias("density"))


def box(values: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The five cuts of a box plot."""
    return values.groupBy(*groups).agg(*[F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in (5, 25, 50, 75, 95)])


def edges(pairs: DataFrame, a: str, b: str, weight: str, most: int | None = None, scope: Column | None = None) -> DataFrame:
    """An edge table, strongest first, of the `most` strongest."""
    found = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(weight).alias("weight"), (F.lit("all") if scope is None else scope).alias("scope"))
    ordered = found.orderBy(F.desc("weight"), "src", "dst")
    return ordered.limit(most) if most else ordered


def degrees(edge_table: DataFrame) -> DataFrame:
    """How many edges each node has, and their mean weight."""
    ends = edge_table.select(F.col("src").alias("node"), "weight").unionByName(edge_table.select(F.col("dst").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.avg("weight").alias("mean_weight"))
