"""Prosody scores: texts against tune patterns and rhyme lexicons, as joins and one aggregation without any UDF.

Lexicon tables have one row for each character or slot, a fixed size that does not grow with the texts, so Spark broadcasts
them by their size; only the list of patterns, which is met by a condition that is no equality, is broadcast by a hint, after
its rows are counted. `compat` checks tones only, as rhyme groups are never reached there; `strict` also wants every later rhyme in the
group, or merged class, of the first rhyme of its tone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantorium.functions.text import core_tune, han
from cantorium.session import bounded

FLAT = "平"
TONE_POINTS, RHYME_TONE_POINTS, RHYME_POINTS, FACTOR = 3, 4, 5, 4


def readings_by_char(readings: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """One row a character from (char, tone, group, place): what it can be read as. merged: (label, tone, group)."""
    flat = F.col("tone") == FLAT
    rows = readings.join(merged, ["tone", "group"], "left") if merged is not None else readings.withColumn("label", F.lit(None).cast("string"))
    listed = lambda condition, name: F.array_sort(F.collect_list(F.when(condition, F.struct("place", "group", "label")))).alias(name)
    return rows.groupBy("char").agg(F.max(flat).alias("has_flat"), F.max(~flat).alias("has_oblique"), listed(flat, "flat"), listed(~flat, "oblique"))


def families(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Requested name, pattern and candidate_order: equal core names or one name holding the other; the exact name first, then lexicon order."""
    p = patterns.select("pattern", "pattern_order", core_tune(F.col("pattern")).alias("core_b"))
    n = names.select("requested").distinct().withColumn("core_a", core_tune(F.col("requested")))
    holds = (F.length("requested") >= 2) & (F.col("pattern").contains(F.col("requested")) | F.col("requested").contains(F.col("pattern")))
    found = n.join(bounded(p, "the list of patterns"), (F.col("core_a") == F.col("core_b")) | holds)
    place = F.struct((F.col("pattern") != F.col("requested")).alias("other"), "pattern_order")
    return found.select("requested", "pattern", F.row_number().over(Window.partitionBy("requested").orderBy(place)).alias("candidate_order"))


def score(poems: DataFrame, slots: DataFrame, chars: DataFrame, strict: bool = False) -> DataFrame:
    """The best variant of each poem (poem_id, requested, content): pattern, variant, score, valid, errors, warnings, label, corrected.

    slots: pattern, pattern_order, variant, pos (from 0), tune, is_rhyme. chars: from readings_by_char().
    """
    variants = slots.groupBy("pattern", "pattern_order", "variant").agg(F.count(F.lit(1)).alias("n_slots"))
    routed = families(poems, variants.select("pattern", "pattern_order").distinct())
    texts = poems.withColumn("chars", han(F.coalesce("content", F.lit(""))))
    tried = texts.select("poem_id", "requested", "chars", F.size("chars").alias("n_chars")).join(routed, "requested", "left")
    tried = tried.join(variants.drop("pattern_order"), "pattern", "left")
    fits = F.col("n_slots").isNotNull() & (F.col("n_slots") == F.col("n_chars"))
    placed = tried.filter(fits).select("poem_id", "pattern", "variant", F.posexplode("chars").alias("pos", "char"))
    rows = placed.join(slots.drop("pattern_order"), ["pattern", "variant", "pos"]).join(chars, "char", "left")
    known = F.col("has_flat").isNotNull()
    wants_flat = F.col("tune") == FLAT
    right = F.when(wants_flat, F.col("has_flat")).otherwise(F.col("has_oblique"))
    wrong_tone = known & ~right & (F.col("is_rhyme") | F.col("tune").isin(FLAT, "仄"))
    rows = rows.withColumn("points", F.when(wrong_tone, F.when(F.col("is_rhyme"), RHYME_TONE_POINTS).otherwise(TONE_POINTS)).otherwise(0))
    rhymes = F.col("is_rhyme") & known & right
    rows = rows.withColumn("heard", F.when(rhymes, F.when(wants_flat, F.col("flat")).otherwise(F.col("oblique"))))
    one = Window.partitionBy("poem_id", "pattern", "variant", F.col("tune") == FLAT).orderBy("pos")
    rows = rows.withColumn("anchor", F.first(F.try_element_at("heard", F.lit(1)), ignorenulls=True).over(one))
    if strict:
        same = F.exists("heard", lambda r: (r["group"] == F.col("anchor")["group"]) | F.coalesce(r["label"] == F.col("anchor")["label"], F.lit(False)))
        rows = rows.withColumn("points", F.when(rhymes & ~same, RHYME_POINTS).otherwise(F.col("points")))
    opened = F.when(rhymes, F.struct("pos", F.concat(F.lit("平水韵·"), F.col("anchor")["group"], F.lit("韵")).alias("label")))
    totals = rows.groupBy("poem_id", "pattern", "variant").agg(
        F.sum("points").alias("points"), F.sum((F.col("points") > 0).cast("int")).alias("errors"), F.sum((~known).cast("int")).alias("warnings"),
        F.array_sort(F.collect_list(opened)).alias("opened"),
    )
    label = F.array_join(F.array_distinct(F.transform("opened", lambda x: x["label"])), " | ")
    judged = tried.drop("chars").join(totals.withColumn("label", label).drop("opened"), ["poem_id", "pattern", "variant"], "left")
    judged = judged.withColumns({
        "score": F.when(fits, F.greatest(F.lit(0), 100 - FACTOR * F.coalesce("points", F.lit(0)))).otherwise(0).cast("int"),
        "errors": F.when(fits, F.coalesce("errors", F.lit(0))).otherwise(1).cast("int"),
        "warnings": F.when(fits, F.coalesce("warnings", F.lit(0))).otherwise(0).cast("int"),
        "label": F.coalesce("label", F.lit("")),
        "gap": F.abs(F.col("n_slots") - F.col("n_chars")),
    })
    best = Window.partitionBy("poem_id").orderBy(F.desc("score"), F.asc_nulls_last("gap"), "errors", F.asc_nulls_last("candidate_order"), F.asc_nulls_last("variant"))
    top = judged.withColumn("r", F.row_number().over(best)).filter("r = 1")
    corrected = F.coalesce((F.col("pattern") != F.col("requested")) & (F.col("score") > 0), F.lit(False))
    return top.select("poem_id", "requested", "pattern", "variant", "score", (F.col("score") >= 60).alias("valid"), "errors", "warnings", "label", corrected.alias("corrected"))


# The notes of a score.
NOT_FOUND = "未找到词牌「%s」及其相关变体的数据"
CORRECTED = "💡 智能纠偏：该词字数/格律实际匹配的是「%s」(%d字)，而非「%s」"


def with_notes(scored: DataFrame, poems: DataFrame, slots: DataFrame) -> DataFrame:
    """score()'s rows with n_slots, clauses and note: the text cut by its variant's marks (。after a rhyme or shift, ，after a clause), and what was corrected or not found.

    slots carry is_clause and shift; a text whose length is not the variant's has no clauses.
    """
    sizes = slots.groupBy("pattern", "variant").agg(F.count(F.lit(1)).alias("n_slots"))
    texts = poems.select("poem_id", han(F.coalesce("content", F.lit(""))).alias("chars"))
    sized = scored.join(sizes, ["pattern", "variant"], "left").join(texts, "poem_id")
    placed = sized.filter(F.size("chars") == F.col("n_slots")).select("poem_id", "pattern", "variant", F.posexplode("chars").alias("pos", "char"))
    marked = placed.join(slots.drop("pattern_order"), ["pattern", "variant", "pos"])
    mark = F.when(F.col("shift") | F.col("is_rhyme"), "。").when(F.col("is_clause"), "，").otherwise("")
    whole = marked.groupBy("poem_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("char", mark).alias("c")))).alias("marked"))  # a row for each character of a text
    joined = F.array_join(F.transform("marked", lambda x: x["c"]), "")
    clauses = F.filter(F.split(joined, "(?<=[。，])"), lambda c: c != "")
    note = F.when(F.col("pattern").isNull(), F.format_string(NOT_FOUND, "requested")).when(F.col("corrected"), F.format_string(CORRECTED, "pattern", "n_slots", "requested"))
    return sized.join(whole.select("poem_id", clauses.alias("clauses")), "poem_id", "left").select(*scored.columns, "n_slots", "clauses", note.alias("note"))
