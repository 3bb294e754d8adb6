"""Sources and sinks: CSV, SQLite, lexicons, task files, model answers, streams."""

import json
import sqlite3

from pyspark.sql import functions as F

from cantorium.functions.encoder import cached, hashed_ngrams
from cantorium.operators import graph, tables
from cantorium.sources import files, models, poems, sqlite
from cantorium.streaming.ingest import ingest, sessions


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'he said "hi", ok\nthere', 0.123456789, [1, 2]), ("b", None, None, None)], "k string, t string, x double, l array<int>")
    files.write_csv(df, f"{tmp_path}/out")
    back = {r.k: r for r in files.read_csv(spark, f"{tmp_path}/out").collect()}
    assert (back["a"].t, back["a"].x, back["a"].l) == ('he said "hi", ok\nthere', "0.123457", "[1,2]") and back["b"].x is None
    (tmp_path / "bom.csv").write_bytes("﻿k,t\n1,é\n".encode())
    assert files.read_csv(spark, f"{tmp_path}/bom.csv").columns == ["k", "t"]
    assert "| a |" in files.markdown(df.select("k", "x"), "T") and json.loads(files.run_metadata({"n": df}, seed=1)) == {"n": 2, "seed": 1}
    files.write_text(df, f"{tmp_path}/txt", "concat(k, '!')")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/txt").collect()) == ["a!", "b!"]


def test_csv_keeps_white_space_and_empty_texts(spark, tmp_path):
    texts = [" lead", "trail ", "  ", "\t", "\rx", "x\r\n", "\n", "a\rb", ", ", "\x0bq", "x\x00", '" "', "", None, "\\", 'a\\"']
    df = spark.createDataFrame([(i, t, 0.5 if i % 2 else None) for i, t in enumerate(texts)], "k long, t string, x double").coalesce(1)
    files.write_csv(df, f"{tmp_path}/out")
    back = files.read_csv(spark, f"{tmp_path}/out", "k long, t string, x double").collect()
    assert sorted(tuple(r) for r in back) == [tuple(r) for r in df.collect()]


def test_sqlite_scan_and_normalisation(spark, tmp_path):
    for db, rows in {"a1": [("菩萨蛮", "月", 80.0, "deepseek-v3.2"), ("菩萨蛮", "  ", 90.0, "x")], "b1": [("如梦令", "风", None, ""), ("如梦令", "雨", 10.0, "y")]}.items():
        con = sqlite3.connect(tmp_path / f"{db}.db")
        con.execute("create table ci_data (id integer primary key autoincrement, cipai text, title text, content text, imagery text, category text, model_name text, rhythm_score real, rhythm_errors text, raw_response text)")
        con.executemany("insert into ci_data (cipai, content, rhythm_score, model_name, imagery) values (?, ?, ?, ?, '[\"白玉兰\"]')", rows)
        con.commit()
        con.close()
    rows = sqlite.read_sqlite(spark, {d: f"{tmp_path}/{d}.db" for d in ("a1", "b1")}, "ci_data")
    assert rows.count() == 4 and dict(rows.dtypes)["rhythm_score"] == "double"
    meta = spark.createDataFrame([("a1", "A"), ("b1", "B")], "db string, label string")
    got = {r.uid: r for r in poems.generated(rows, 60, meta).collect()}
    assert set(got) == {"a1:1", "b1:1"}
    assert (got["a1:1"].model, got["b1:1"].model, got["b1:1"].rhythm_score, got["a1:1"].imagery, got["a1:1"].label) == ("deepseek-3.2-thinking", "Unknown", 0.0, ["玉兰"], "A")
    some = sqlite.read_sqlite(spark, {"b1": f"{tmp_path}/b1.db"}, "ci_data", ["id", "content"], "content = '雨'").collect()
    assert [(r.db, r.id, r.content) for r in some] == [("b1", 2, "雨")]


def test_lexicons_and_tasks(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"测试令": {"formats": [{"author": "a", "sketch": "s", "desc": "d", "tunes": [{"tune": "平", "rhythm": "韵"}, {"tune": "仄", "rhythm": "句", "shift": "true"}, {}]}]}}, ensure_ascii=False))
    slots = files.read_patterns(spark, f"{tmp_path}/p.json").orderBy("pos").collect()
    assert [(r.tune, r.is_rhyme, r.is_clause, r.shift) for r in slots] == [("平", True, False, False), ("仄", False, True, True), ("中", False, False, False)]
    (tmp_path / "r.json").write_text(json.dumps({"平声一东": "东风", "去声一送": "送"}, ensure_ascii=False))
    assert {(r.char, r.tone, r.group, r.place) for r in files.read_rhymes(spark, f"{tmp_path}/r.json").collect()} == {("东", "平", "东", 0), ("风", "平", "东", 0), ("送", "去", "送", 1)}
    (tmp_path / "m.json").write_text(json.dumps([{"韵部名称": "第一部", "声调": "平声", "韵目": "东韵、冬韵"}], ensure_ascii=False))
    assert {(r.label, r.tone, r.group) for r in files.read_merged_classes(spark, f"{tmp_path}/m.json").collect()} == {("第一部", "平", "东"), ("第一部", "平", "冬")}
    config = {"providers": {"p": {"api_key": "k", "base_url": "u"}}, "tasks": [{"name": "t", "provider": "p", "model": "m", "prompt_name": "x", "cipai_pool": ["a"], "total_requests": 2}, {"name": "v", "provider": "none"}]}
    (tmp_path / "t.json").write_text(json.dumps(config))
    tasks = {r["name"]: r for r in files.read_tasks(spark, f"{tmp_path}/t.json").collect()}
    assert tasks["t"].base_url == "u" and tasks["v"].base_url is None


def test_generation_and_annotation(spark):
    def client():
        def answer(prompt: str, model: str) -> str:
            if "boom" in prompt:
                raise RuntimeError("no")
            if prompt.startswith("annotate"):
                n = prompt.count("\n")
                return "x " + json.dumps([{"id": i + 1, "imagery": [f"i{i}"], "category": "c"} for i in reversed(range(n))]) if "swap" in prompt else json.dumps([{"imagery": ["p"], "category": "c"}] * n)
            return '<think>hm</think> {"cipai": "如梦令", "title": "t", "content": "' + prompt + '"} end'

        return answer

    tasks = spark.createDataFrame([("t", "m", "x", ["如梦令"], "秋", 2), ("u", "m", "y", ["a"], None, 1)], "name string, model string, prompt_name string, cipai_pool array<string>, theme string, total_requests long")
    prompts = spark.createDataFrame([("x", "写{cipai}于{theme}"), ("y", "boom")], "prompt_name string, template string")
    got = {(r.task, r.request): r for r in models.generate(tasks, prompts, client, 2).collect()}
    assert got["t", 2].content == "写如梦令于秋" and got["u", 1].content is None and "RuntimeError" in got["u", 1].error
    pending = spark.createDataFrame([(i, f"c{i}", None if i % 2 else "") for i in range(1, 8)], "id long, content string, imagery string")
    for word in ("swap", "plain"):
        notes = {r.id: json.loads(r.value) for r in models.annotate(poems.pending(pending), client, f"annotate {word}", "m").collect()}
        assert set(notes) == set(range(1, 8))
    changes = spark.createDataFrame([(1, "new")], "id long, imagery string")
    assert {r.id: r.imagery for r in tables.update_by_key(pending, changes, "id", ["imagery"]).collect()}[1] == "new"


def test_streams(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/table"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, t string").write.parquet(source)
    for more in (None, [(2, "again"), (3, "c")]):
        if more:
            spark.createDataFrame(more, "id long, t string").write.mode("append").parquet(source)
        ingest(spark, source, "id long, t string", target, f"{tmp_path}/cp", "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]
    events = spark.createDataFrame([(1, 0), (1, 600), (1, 9000)], "user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.n for r in sessions(events).collect()) == [1, 2]


def test_encoder_cache(spark, tmp_path):
    texts = spark.createDataFrame([(1, "明月"), (2, "春风"), (3, "明月")], "id long, text string")
    first = {r.id: r.embedding for r in cached(texts, "id", "text", hashed_ngrams(16), f"{tmp_path}/c", "v1").collect()}
    again = {r.id: r.embedding for r in cached(texts, "id", "text", hashed_ngrams(16), f"{tmp_path}/c", "v1").collect()}
    assert first == again and first[1] == first[3] != first[2]


def test_communities(spark):
    rows = [(a, b, 1.0) for group in ((1, 2, 3, 4), (5, 6, 7), (8, 9, 10)) for a in group for b in group if a < b] + [(4, 5, 0.1)]
    edges = spark.createDataFrame([(*r, "all") for r in rows], "src long, dst long, weight double, scope string")
    got = {r.node: r.community for r in graph.communities(edges).collect()}
    assert got == {n: g[0] for g in ((1, 2, 3, 4), (5, 6, 7), (8, 9, 10)) for n in g}


def test_lexical_best_and_rerank_agree(spark):
    import difflib

    from cantorium.operators import candidates

    asked = spark.createDataFrame([(1, "明月照孤舟"), (2, "春风吹柳")], "query_id long, text string")
    rows = [(i, t) for i, t in enumerate(["孤舟明月", "明月照城", "春风柳绿", "秋雨", "明月照孤舟夜"])]
    corpus = spark.createDataFrame(rows, "corpus_id long, text string")
    want = {q: max((difflib.SequenceMatcher(None, t, c).ratio(), -i) for i, c in rows) for q, t in ((1, "明月照孤舟"), (2, "春风吹柳"))}
    got = {r.query_id: (r.score, -r.corpus_id) for r in candidates.lexical_best(asked, corpus).collect()}
    assert got == want
    lexical = candidates.ngram_candidates(asked, corpus, 5)
    merged = candidates.merge_candidates(lexical.limit(0), lexical, asked, corpus, 5)
    assert {r.query_id: (r.score, -r.corpus_id) for r in candidates.rerank(merged, asked, corpus, 1).collect()} == want
