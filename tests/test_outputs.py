"""Notes of scores, document sections, CSV options, chart pages, bounded broadcasts, intermediate tables."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from cantorium.functions import text
from cantorium.operators import prosody
from cantorium.plans import literals
from cantorium.session import bounded, forget, materialize
from cantorium.sources import files, poems


def test_notes_and_clauses(spark):
    slots, chars = literals.lexicon(spark)
    slots = slots.withColumn("is_clause", F.col("pos") == 0).withColumn("shift", F.lit(False))
    rows = spark.createDataFrame(list(literals.POEMS), "poem_id int, requested string, content string")
    got = {r.poem_id: r for r in prosody.with_notes(prosody.score(rows, slots, chars), rows, slots).collect()}
    assert len(got) == len(literals.POEMS)
    assert got[1].clauses == ["风，", "动东。"] and got[1].note is None and got[6].clauses is None or got[6].corrected
    assert got[8].clauses is None and got[8].note == "未找到词牌「无此调」及其相关变体的数据"
    for r in got.values():
        if r.corrected:
            assert r.note == f"💡 智能纠偏：该词字数/格律实际匹配的是「{r.pattern}」({r.n_slots}字)，而非「{r.requested}」"


def test_sections(spark):
    page = "# A\nold\nolder\n## B\nkeep\n# C"
    row = spark.createDataFrame([(page, "no heading", None)], "x string, y string, z string").select(
        text.splice(F.col("x"), "# A", "## B", "# N\nnew").alias("a"), text.splice(F.col("x"), "# C", "# D", "n").alias("b"), text.splice(F.col("y"), "#", "##", "n").alias("c"),
        text.splice(F.col("z"), "#", "##", "n").alias("d"), text.rename_headings(F.col("x"), {"B": "Beta", "C": "Gamma", "keep": "lost"}).alias("e"),
    ).first()
    assert list(row) == ["# N\nnew\n## B\nkeep\n# C", page, "no heading", None, "# A\nold\nolder\n## Beta\nkeep\n# Gamma"]


def test_csv_with_mark_headers_and_all_columns(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 0.5)], "id int, x double"), spark.createDataFrame([(2, "t")], "id int, y string")
    both = files.union_of_columns([a, b])
    assert both.columns == ["id", "x", "y"]
    files.write_csv(both.coalesce(1), f"{tmp_path}/out", digits=4, headers={"id": "编号", "x": "相似度"}, bom=True)
    (part,) = [f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".csv")]
    raw = open(f"{tmp_path}/out/{part}", "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.decode("utf-8-sig").splitlines() == ["编号,相似度,y", "1,0.5000,", "2,,t"]


def test_chart_page(spark):
    nodes = spark.createDataFrame([(1, "</script><b>"), (2, None)], "node int, name string")
    page = files.chart_html("a & b", {"nodes": nodes})
    held = re.search(r'<script type="application/json" id="data">(.*?)</script>', page, re.S).group(1)
    assert json.loads(held) == {"nodes": [{"node": 1, "name": "</script><b>"}, {"node": 2, "name": None}]} and "<title>a &amp; b</title>" in page and "<td>&lt;/script&gt;&lt;b&gt;</td>" in page
    with pytest.raises(ValueError, match="rows"):
        files.chart_html("t", {"nodes": nodes}, most=1)


def test_broadcasts_are_bounded(spark):
    with pytest.raises(ValueError, match="a list has more than 3 rows"):
        bounded(spark.range(4), "a list", 3)
    assert bounded(spark.range(3), "a list", 3).count() == 3


def test_intermediate_tables_can_be_removed(spark):
    frame = materialize(spark.range(5), "gone")
    assert frame.count() == 5
    path = frame.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and forget(spark) >= 1 and not os.path.exists(path) and forget(spark) == 0


def test_table_of_poems(spark):
    spark.sql("drop table if exists poems_of_test")
    for _ in range(2):
        assert poems.create_table(spark, "poems_of_test").columns[:3] == ["id", "cipai", "title"]
    spark.sql("drop table poems_of_test")
