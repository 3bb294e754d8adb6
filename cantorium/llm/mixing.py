"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a curve, a piecewise-linear schedule of that weight over training time from 0 to 1. The
words that a source gives until time t are the integral of its schedule; a document's place in its source's cumulative
words, put through the inverse of that integral, is its training position. A source that gives more words than it has
goes round again, so a document has a position for each of its copies.

A source's documents are ordered by a hash of their ids, then of their whole rows, then by a number. Cumulative words come
from sums over range partitions of that order and, within one, a window, so no source, id or row is ever gathered in one task.

Defined results: null text has size 0; null sources form one source, ordered last; null doc_ids are mixed like others;
rows that share an id or all columns are separate documents; an empty table gives an empty plan; further columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantorium.llm.rows import free, row_hash
from cantorium.session import materialize

#: Weights of the sources in code point order, over and over.
WEIGHTS = (5, 2, 1)
#: For each weight, knots (time, share of the weight then): heavy sources lead, light ones come towards the end.
CURVES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: A source gives at most so many times its words.
MOST_REPEATS = 3
_KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def inverse_demand(share: Column, curve: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule has given this share of all that it gives from 0 to 1."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(curve, curve[1:])]
    want, done, found = share * F.lit(float(sum(areas))), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(curve, curve[1:]), areas):
        rest, slope = F.greatest(want - F.lit(done), F.lit(0.0)), (w1 - w0) / (t1 - t0)
        # t with w0*t + slope*t*t/2 = rest, in a form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.lit(t0) + F.when(F.lit(w0) + root > 0, F.lit(2.0) * rest / (F.lit(w0) + root)).otherwise(0.0)
        done += area
        here = F.least(time, F.lit(t1))
        found = F.when(want < F.lit(done), here) if found is None else found.when(want < F.lit(done), here)
    return found.otherwise(F.lit(curve[-1][0]))


def _numbered(totals: DataFrame) -> DataFrame:
    """totals with `number`, the place of source_key in code point order, from 0; no task sees more than its range of keys."""
    placed = totals.repartitionByRange("source_key").sortWithinPartitions("source_key").withColumn("row", F.monotonically_increasing_id())
    placed = materialize(placed, "mix-sources").withColumn("part", F.shiftright("row", 33))
    before, so_far = [], 0
    for part, n in sorted(tuple(r) for r in placed.groupBy("part").count().collect()):  # a row for each partition
        before.append((part, so_far))
        so_far += n
    before = totals.sparkSession.createDataFrame(before, "part long, before long")
    within = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "part").withColumn("number", F.col("before") + within).drop("part", "row", "before")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """From (source_key, source_size): also kind (place in weights) and target, the words that the mix wants.

    All words are shared by weight; what a source's limit of `most` times its size cuts off is shared by weight among
    the others, until none is above. The share that a unit of weight gets only rises as sources reach their limits, so it
    is found by sums over all sources, again and again until no further source is limited.
    """
    kind = (F.col("number") % len(weights)).cast("int")
    ranked = _numbered(totals).withColumn("kind", kind)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("kind") + 1)
    ranked = ranked.withColumns({"w": w, "limit": F.col("source_size") * float(most)}).withColumn("level", F.col("limit") / F.col("w"))
    free_words = free_w = None
    share = -1.0
    while True:
        limited = F.col("level") < F.lit(share)
        sums = ranked.agg(
            F.sum("source_size").cast("double"), F.sum("w"),
            F.sum(F.when(limited, F.col("limit")).otherwise(0.0)), F.sum(F.when(limited, F.col("w")).otherwise(0.0)),
        ).first()
        if sums[1] is None or sums[1] <= sums[3]:
            break
        free_words, free_w = sums[0] - sums[2], sums[1] - sums[3]
        was, share = share, free_words / free_w
        if share <= was:
            break
    if free_w is None:  # no sources
        return ranked.select("source_key", "source_size", "kind", F.lit(0.0).alias("target"))
    shared = F.col("w") * F.lit(free_words / free_w)
    target = F.when(F.col("level") < F.lit(share), F.col("limit")).otherwise(shared)
    return ranked.select("source_key", "source_size", "kind", target.alias("target"))


def _source_key() -> Column:
    """Never null; sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, curves: tuple = CURVES, most: int = MOST_REPEATS) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, positions (ascending, one a copy)."""
    rows = plan_rows(docs.withColumn(free(docs, "row")[0], F.lit(None).cast("long")), free(docs, "row")[0], weights, curves, most)
    return rows.drop("row")


def plan_rows(docs: DataFrame, row: str, weights: tuple[float, ...] = WEIGHTS, curves: tuple = CURVES, most: int = MOST_REPEATS) -> DataFrame:
    """plan() with the column `row` of docs as the column row."""
    doc_id, source, text = F.col("doc_id"), F.col("source").cast("string"), F.col("text").cast("string")
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    rows = docs.select(
        doc_id.alias("doc_id"),
        source.alias("source"),
        _source_key().alias("source_key"),
        F.col(f"`{row}`").cast("long").alias("row"),
        row_hash(docs.drop(row)).alias("row_hash"),
        word_count(text).alias("size"),
        F.conv(F.substring(F.md5(name), 1, _KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )
    order = ["key", "row_hash", "number"]
    rows = materialize(rows.withColumn("number", F.monotonically_increasing_id()), "mix-sizes")
    rows = materialize(rows.repartitionByRange("source_key", *order).withColumn("bucket", F.spark_partition_id()), "mix-ordered")
    buckets = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    goals = targets(buckets.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    so_far = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0))).join(goals, "source_key")
    within = Window.partitionBy("source_key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["source_key", "bucket"]).withColumn("at", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    def position(share: Column) -> Column:
        found = None
        for kind, curve in enumerate(curves):
            here = inverse_demand(share, curve)
            found = F.when(F.col("kind") == kind, here) if found is None else found.when(F.col("kind") == kind, here)
        return found

    middle = [F.col("source_size") * float(k) + F.col("at") + F.col("size") / 2.0 for k in range(most)]
    slots = F.array(*[F.when(m < F.col("target"), position(m / F.col("target"))) for m in middle])
    placed = placed.withColumn("positions", F.filter(slots, lambda t: t.isNotNull()))
    placed = materialize(placed.select("doc_id", "source", "source_key", "bucket", "row", "size", "source_size", "target", "at", "positions"), "mix-places")
    placed = _nearer(placed, most)
    return placed.select("doc_id", "source", "row", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), "positions")


def _nearer(placed: DataFrame, most: int) -> DataFrame:
    """Give or take one copy of one document a source, where that brings the source's words nearer to its target.

    A document's `at` and size name it in its source, as documents of size 0 are never chosen.
    """
    by_bucket = placed.groupBy("source_key", "bucket").agg(F.sum(F.col("size") * F.size("positions")).alias("got"), F.first("target").alias("target"))
    own = Window.partitionBy("source_key")
    gaps = by_bucket.select("source_key", "bucket", (F.col("target") - F.sum("got").over(own)).alias("gap"))  # a row for each bucket of a source
    able = (F.size("positions") < most) & (F.col("gap") > 0) | (F.size("positions") > 0) & (F.col("gap") < 0)
    miss = F.abs(F.col("size") - F.abs("gap"))
    useful = placed.join(gaps, ["source_key", "bucket"]).filter(able & (F.col("size") > 0) & (miss < F.abs("gap")))
    nearest = useful.groupBy("source_key", "bucket").agg(F.min(F.struct(miss.alias("miss"), "at", "gap", "bucket")).alias("nearest"))
    best = nearest.groupBy("source_key").agg(F.min("nearest").alias("best"))
    best = best.select("source_key", F.col("best.bucket").alias("bucket"), F.col("best.at").alias("chosen_at"), F.col("best.gap").alias("chosen_gap"))
    chosen = F.coalesce((F.col("at") == F.col("chosen_at")) & (F.col("size") > 0), F.lit(False))
    more, fewer = F.concat("positions", F.array(F.lit(1.0))), F.slice("positions", F.lit(1), F.greatest(F.size("positions") - 1, F.lit(0)))
    changed = F.when(chosen, F.when(F.col("chosen_gap") > 0, more).otherwise(fewer)).otherwise(F.col("positions"))
    return placed.join(best, ["source_key", "bucket"], "left").withColumn("positions", changed)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents' rows in training order, each as often as the plan takes it (range-sorted by position).

    Rows are numbered in a table of their own, so that rows that share an id, a text or everything stay apart.
    """
    row, at = free(docs, "row", "at")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    chosen = plan_rows(numbered, row, **how).filter(F.size("positions") > 0)
    chosen = chosen.select(F.col("row").alias(row), F.col("positions").alias(at))
    placed = numbered.join(chosen, row).withColumn(at, F.explode(at))
    return placed.orderBy(at, row).select(*[F.col(f"`{c}`") for c in docs.columns])
