"""Scans of the poem tables with their normalisation: models, blank texts, score thresholds, JSON cells, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantorium.functions.text import error_list, json_list, lookup, strip

# Raw model names and the names that reports use.
MODEL_NAMES = {
    "doubao-seed-2-0-pro-260215": "doubao-seed-2.0-pro",
    "deepseek-reasoner": "deepseek-3.2-thinking",
    "deepseek-v3.2": "deepseek-3.2-thinking",
    "qwen3.5-plus-2026-02-15": "qwen3.5-plus",
    "qwen3.6-plus": "qwen3.6-plus",
    "gemini-3.1-pro-preview": "gemini-3.1-pro",
    "gemini-3-flash-preview": "gemini-3-flash",
}
GENERATED = "id bigint, cipai string, title string, content string, imagery string, category string, model_name string, rhythm_score double, rhythm_errors string, raw_response string"
HUMAN = "id bigint, author string, full_rhythmic string, cipai string, content string, rhythm_score double"


def create_table(spark: SparkSession, name: str, schema: str = GENERATED) -> DataFrame:
    """The table of poems, made if it is not there yet."""
    spark.sql(f"create table if not exists {name} ({schema}) using parquet")
    return spark.table(name)


def model_name(raw: Column, known: dict[str, str] | None = None) -> Column:
    """The canonical name; empty ones are Unknown, unknown ones pass through. known: another version of the map."""
    return lookup(F.coalesce(F.nullif(raw, F.lit("")), F.lit("Unknown")), MODEL_NAMES if known is None else known)


def has_content(content: Column, trimmed: bool = True) -> Column:
    """Blank policy: spaces only count as blank, or only the empty text does."""
    return content.isNotNull() & ((F.trim(content) if trimmed else content) != "")


def good_enough(score: Column, least: float) -> Column:
    """At least the threshold, or unknown; a threshold of 0 or less lets everything pass."""
    return F.lit(True) if least <= 0 else score.isNull() | (score >= least)


def generated(rows: DataFrame, least_score: float = 60, metadata: DataFrame | None = None, trimmed: bool = True) -> DataFrame:
    """Usable poems with uid db:id, model, imagery and error lists, and their experiment's metadata (one row a db)."""
    kept = rows.filter(has_content(F.col("content"), trimmed) & good_enough(F.col("rhythm_score"), least_score))
    out = kept.select(
        "db", "id", F.concat_ws(":", "db", "id").alias("uid"), "cipai", "title", "content", json_list(F.col("imagery")).alias("imagery"), strip(F.col("category")).alias("category"),
        model_name(F.col("model_name")).alias("model"), F.coalesce("rhythm_score", F.lit(0.0)).alias("rhythm_score"), error_list(F.col("rhythm_errors")).alias("errors"),
    )
    return out if metadata is None else out.join(metadata, "db")


def human(rows: DataFrame, tunes: DataFrame | None = None, trimmed: bool = True) -> DataFrame:
    """The human corpus, of some tunes (column cipai) only if given."""
    kept = rows.filter(has_content(F.col("content"), trimmed))
    kept = kept.select("id", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("full_rhythmic", "cipai").alias("full_rhythmic"), "cipai", "content", "rhythm_score")
    return kept if tunes is None else kept.join(tunes.select("cipai").distinct(), "cipai", "left_semi")


def allowed_tunes(metadata: DataFrame, free: DataFrame) -> DataFrame:
    """The union of the experiments' tune lists and the tunes of those without a list."""
    listed = metadata.select(F.explode("allowed_cipais").alias("cipai"))
    return listed.unionByName(free.select("cipai")).distinct()


def pending(rows: DataFrame) -> DataFrame:
    """Poems that are not annotated yet."""
    return rows.filter(F.coalesce(F.col("imagery"), F.lit("")) == "").orderBy("id")


def mock(spark: SparkSession) -> DataFrame:
    """A literal corpus of three families and one outlier (our own texts)."""
    rows = [(f, i, t) for f, texts in MOCK.items() for i, t in enumerate(texts)]
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], "id long, family string, member int, text string")


MOCK = {
    "moon": ["明月照孤舟夜色凉", "明月照孤舟夜色深", "明月照孤城夜色凉", "明月照孤舟秋色凉"],
    "rain": ["细雨湿花春意浓", "细雨湿衣春意浓", "细雨湿花春意迟"],
    "west": ["西风吹雁过重楼", "西风吹雁过高楼", "西风吹叶过重楼"],
    "none": ["铁马金戈入梦来"],
}
