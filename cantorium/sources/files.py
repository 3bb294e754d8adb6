"""File sources and sinks: CSV, JSON lexicons and task configurations, reports."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What an unquoted empty cell is taken for, so that a quoted one stays an empty text.
NOTHING = "\ufdd0nothing"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, line breaks inside cells; a byte order mark is dropped. Empty cells are null, quoted ones are empty texts."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", NOTHING)
    return (reader.schema(schema) if schema else reader).csv(path)


def union_of_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of several tables with the union of their columns, in order of first appearance; what a table lacks is null."""
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame, allowMissingColumns=True)
    return found


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, digits: int | None = 6, mode: str = "overwrite", headers: dict[str, str] | None = None, bom: bool = False) -> None:
    """CSV with a header; numbers with so many decimals (None: as they are); arrays and structs as JSON.
    Texts keep the white space at their ends, and empty ones are quoted.

    headers: other names for columns, such as localised ones. bom: begin each file with a byte order mark, as spreadsheets want.
    """
    out = []
    for field in df.select(*columns).schema if columns else df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)) and digits is not None:
            c = F.format_string(f"%.{digits}f", c.cast("double"))
            c = F.when(F.col(f"`{field.name}`").isNotNull(), c)
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        name = (headers or {}).get(field.name, field.name)
        out.append(c.alias(f"\ufeff{name}" if bom and not out else name))
    df.select(*out).write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_text(df: DataFrame, path: str, line: str, mode: str = "overwrite") -> None:
    """One line of text a row; line is a SQL expression."""
    df.select(F.expr(line).alias("value")).write.mode(mode).text(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report's table as Markdown; reports have at most so many rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(x) for x in row) + " |" for row in rows)]) + "\n"


def chart_html(title: str, data: dict[str, DataFrame], most: int = 20_000) -> str:
    """A page that carries the data of a chart (nodes and edges, boxes, a matrix, a density) as JSON and shows it as tables; drawing is left to the reader."""
    found = {}
    for name, df in data.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a chart of more than {most} rows")
        found[name] = [row.asDict(recursive=True) for row in rows]
    cell = lambda x: "" if x is None else escape(f"{x:.4f}" if isinstance(x, float) else str(x))
    head = lambda df: "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = lambda rows: "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows)
    tables = "".join(f"<h2>{escape(name)}</h2><table><tr>{head(df)}</tr>{body(found[name])}</table>" for name, df in data.items())
    told = json.dumps(found, ensure_ascii=False, default=str).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1>{tables}<script type="application/json" id="data">{told}</script>\n'


def run_metadata(counts: dict[str, DataFrame], **settings) -> str:
    """A run's settings and the row counts of its tables as JSON."""
    return json.dumps(settings | {name: df.count() for name, df in counts.items()}, ensure_ascii=False, indent=2, sort_keys=True)


_VARIANT = "struct<author:string,sketch:string,desc:string,tunes:array<struct<tune:string,rhythm:string,shift:string>>>"


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Slots of tune patterns: pattern, pattern_order, variant, pos (from 0), tune, is_rhyme, is_clause, shift."""
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", f"map<string,struct<formats:array<{_VARIANT}>>>"))
    named = text.select(F.posexplode(entries).alias("pattern_order", "entry"))
    variants = named.select("pattern_order", F.col("entry.key").alias("pattern"), F.posexplode("entry.value.formats").alias("variant", "format"))
    slots = variants.select("pattern", "pattern_order", "variant", F.posexplode("format.tunes").alias("pos", "slot"))
    return slots.select(
        "pattern", "pattern_order", "variant", "pos", F.coalesce("slot.tune", F.lit("中")).alias("tune"), F.coalesce(F.col("slot.rhythm") == "韵", F.lit(False)).alias("is_rhyme"),
        F.coalesce(F.col("slot.rhythm") == "句", F.lit(False)).alias("is_clause"), F.coalesce(F.lower("slot.shift") == "true", F.lit(False)).alias("shift"),
    )


def read_rhymes(spark: SparkSession, path: str) -> DataFrame:
    """Readings of characters from a map of rhyme keys to characters: char, tone, group, place."""
    from cantorium.functions.text import rhyme_group

    text = spark.read.text(path, wholetext=True)
    keys = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("place", "entry"))
    return rhyme_rows(keys.select("place", F.col("entry.key").alias("key"), F.col("entry.value").alias("chars")), rhyme_group)


def rhyme_rows(keys: DataFrame, group) -> DataFrame:
    from cantorium.functions.text import chars

    return keys.select(F.explode(chars(F.col("chars"))).alias("char"), F.substring("key", 1, 1).alias("tone"), group(F.col("key")).alias("group"), "place")


def read_merged_classes(spark: SparkSession, path: str) -> DataFrame:
    """Merged rhyme classes: label, tone, group."""
    rows = spark.read.option("multiLine", True).schema("`韵部名称` string, `声调` string, `韵目` string").json(path)
    groups = F.filter(F.split("韵目", "、"), lambda g: g != "")
    return rows.select(F.col("韵部名称").alias("label"), F.substring("声调", 1, 1).alias("tone"), F.explode(groups).alias("g")).select("label", "tone", F.regexp_replace("g", r"[（(].*?[）)]|韵", "").alias("group"))


TASK = "name:string,provider:string,model:string,prompt_name:string,cipai_pool:array<string>,theme:string,db_name:string,total_requests:long,max_concurrency:long,request_interval:double"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks with their provider's base_url and api_key, null where the provider is unknown."""
    return task_rows(spark.read.text(path, wholetext=True))


def task_rows(text: DataFrame) -> DataFrame:
    """read_tasks() from a configuration's text (column value)."""
    root = text.select(F.from_json("value", f"struct<providers:map<string,struct<api_key:string,base_url:string>>,tasks:array<struct<{TASK}>>>").alias("c"))
    tasks = root.select(F.posexplode("c.tasks").alias("place", "task")).select("place", "task.*")
    providers = root.select(F.explode(F.map_entries("c.providers")).alias("p")).select(F.col("p.key").alias("provider"), "p.value.*")
    return tasks.join(providers, "provider", "left")
