"""The pipeline's stages against plain Python on a small table."""

from collections import Counter

import corpus_pipeline
from cantorium.llm import toxicity
from cantorium.session import materialize, table
from test_secrets import expected
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    held = {"docs": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = held[name] = materialize(stage(spark, docs, SF), "test-stage")
        if name != "packing":
            assert docs.columns == held["docs"].columns and docs.dtypes == held["docs"].dtypes
    labels = table(spark, SF, "labels")
    model = toxicity.train(held["docs"], labels)
    scores = {r.doc_id: r.score for r in toxicity.score(held["docs"], model).collect()}
    assert {r.doc_id for r in held["toxicity"].collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert sum(scores[i] >= toxicity.THRESHOLD for i in toxic) > 0.8 * len(toxic)

    before = {r.doc_id: r.text for r in held["toxicity"].collect()}
    prints = {i: plain_fingerprint(t) for i, t in before.items()}
    root = plain_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    kept = {r.doc_id: r.text for r in held["near_duplicates"].collect()}
    assert set(kept) == set(root.values()) and all(before[i] == t for i, t in kept.items())

    clean = {r.doc_id: r for r in held["secrets"].collect()}
    assert set(clean) == set(kept) and all(r.n_chars == len(r.text) for r in clean.values())
    assert all(not expected(r.text) for r in clean.values())
    assert all(clean[i].text == t or "[SECRET]" in clean[i].text for i, t in kept.items())

    times = Counter(r.doc_id for r in held["mixing"].collect())
    assert max(times.values()) <= 3 and set(times) <= set(clean)
    pieces = held["packing"].collect()
    tokens = Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert all(tokens[r.doc_id] == times[r.doc_id] * r.doc_tokens for r in pieces) and set(tokens) == set(times)
    assert len({r.sequence_id for r in pieces}) == len(pieces)


def test_run_gives_the_stages_rows(spark):
    small = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, small).drop("sequence_id").collect()
    docs = table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), "test-stage")
    assert sorted(map(repr, rows)) == sorted(map(repr, docs.drop("sequence_id").collect()))


ODD = "doc_id long, text string, lang string, source string, n_chars int, toxic int, row string, at double, spans string, tags map<string,int>"


def odd(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), 7, "r", 0.5, "s", {"k": 1}) for i, t, s in rows]
    return spark.createDataFrame(full, ODD).repartition(3)


def test_stages_on_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, long, "a"), (4, "password=hunter22 and words", None), (None, "no id here at all", "b"), (None, "no id here at all", "b"), (5, "one two three four", "b"), (5, "one two three four", "b"), (5, "five six seven eight nine", "b"), (6, "five six seven eight nine", "b")]
    docs = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = materialize(stage(spark, docs, SF), f"test-{name}")
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        found = Counter((r.doc_id, r.text) for r in got.collect())
        assert all(r.tags == {"k": 1} and r.toxic == 7 and r.row == "r" and r.at == 0.5 and r.spans == "s" for r in got.collect())
        if name == "toxicity":
            assert set(found) <= {(i, t) for i, t, _ in rows} and (3, long) in found
            got = docs  # whatever the classifier thinks of them, go on with all
        elif name == "near_duplicates":
            assert found == Counter([(1, None), (3, long), (4, rows[3][1]), *[(None, rows[4][1])] * 2, (5, rows[6][1]), (5, rows[8][1])])
        elif name == "secrets":
            assert (4, "[SECRET] and words") in found and (1, None) in found and sum(found.values()) == 7
        else:
            assert set(found) <= {(r.doc_id, r.text) for r in docs.collect()} and max(n for k, n in found.items() if k[0]) <= 3
        docs = got
    pieces = corpus_pipeline.packing_stage(spark, odd(spark, rows), SF).collect()
    assert {(r.doc_id, r.doc_tokens) for r in pieces if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}


def test_stages_on_an_empty_table(spark):
    docs = odd(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.collect() == [] and (name == "packing" or got.columns == docs.columns)


def test_toxicity_without_labels_keeps_all(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for k, rows in enumerate([[], [(99, 1, 1)]]):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / f"{k}/labels.parquet"))
        assert corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path / str(k))).count() == 2
