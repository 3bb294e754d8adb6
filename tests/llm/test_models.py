"""Held-out accuracy and edge cases of the two classifiers."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantorium.llm import language, toxicity
from cantorium.session import table

SF = "/root/testdata/sf0.1"
EDGES = [(900_001, None), (900_002, ""), (900_003, " \n 123 !!"), (None, "some words here"), (900_004, "the and of " * 60_000), (900_004, "the and of " * 60_000)]


def edges(spark):
    return spark.createDataFrame([(i, t, "q", 1.0) for i, t in EDGES], "doc_id long, text string, at string, score double")


def area(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / ones / (len(label) - ones)


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = toxicity.remainder(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, labels, ~held)
    assert 0 < len(model.weights) < 20_000
    got = toxicity.score(docs, model).filter(held).join(labels, "doc_id").toPandas()
    score, label = got["score"].to_numpy(), got["toxic"].to_numpy()
    assert area(score, label) > 0.97
    flagged = score >= toxicity.THRESHOLD
    assert (flagged & (label == 1)).sum() / flagged.sum() > 0.9 and (flagged & (label == 1)).sum() / label.sum() > 0.7
    odd = toxicity.score(edges(spark), model).collect()
    assert len(odd) == len(EDGES) and all(0 <= r.score <= 1 for r in odd)
    by = {r.doc_id: r.score for r in odd}
    assert by[900_001] == by[900_002] == pytest.approx(1 / (1 + np.exp(-model.bias)))


def test_toxicity_is_repeatable_and_bounded(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(5), labels.union(labels))
    assert a.bias == b.bias and (a.coordinates == b.coordinates).all() and (a.weights == b.weights).all()
    assert toxicity.sample(docs, labels, most=50).count() == 50


def test_the_training_sample_is_bounded_in_rows_and_features(spark):
    docs = spark.createDataFrame([(1, f"word{i} and more") for i in range(1000)] + [(2, "same text")] * 500, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.sample(docs, labels, most=50).select("text").distinct().count() == 50
    whole = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(3), labels)
    assert whole.bias == again.bias and (whole.weights == again.weights).all()
    assert toxicity.train(docs, labels, most_features=0).bias == 0.0


def plain_fit(rows, epochs):
    """FTRL-proximal, one coordinate at a time."""
    z, n, bias_z, bias_n = {}, {}, 0.0, 0.0
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + n[i] ** 0.5) / a + l2)
    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            bias = -bias_z / ((b + bias_n**0.5) / a)
            g = 1 / (1 + math.exp(-max(-35, min(35, bias + sum(w.values()))))) - y
            for i in x:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((was + g * g) ** 0.5 - was**0.5) / a * w[i]
                n[i] = was + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / a * bias
            bias_n += g * g
    return -bias_z / ((b + bias_n**0.5) / a), {i: weight(i) for i in z if weight(i)}


def test_fit_against_one_coordinate_at_a_time():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 60, 12)).astype(np.uint32), int(rng.random() < 0.4)) for _ in range(300)]
    model = toxicity.fit(rows)
    bias, weights = plain_fit([(x.tolist(), y) for x, y in rows], toxicity.EPOCHS)
    assert model.bias == pytest.approx(bias) and model.coordinates.tolist() == sorted(weights)
    assert model.weights.tolist() == pytest.approx([weights[i] for i in sorted(weights)], rel=1e-5)


def plain_coordinates(text):
    """Words, neighbours and words with one between, hashed by the same numbers."""
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower())
    h = [zlib.crc32(w) for w in words]
    m = (1 << 32) - 1
    raw = h + [a * 31 + b * 0x85EBCA6B for a, b in zip(h, h[1:])] + [a * 37 + b * 0xC2B2AE35 for a, b in zip(h, h[2:])]
    raw = [(x & m) * 0x9E3779B1 & m for x in raw]
    return sorted({(x ^ x >> 15) & (toxicity.DIMENSIONS - 1) for x in raw})


def test_features_of_texts():
    for text in ["", "one", "One two", "a b c d a b c", "Ñandú, x-y! 12 é", "w " * 700_000 + "end"]:
        assert toxicity.features(text.encode()).tolist() == plain_coordinates(text)


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(edges(spark), labels)
    assert {r.score for r in toxicity.score(edges(spark), model).collect()} == {0.5}
    assert toxicity.score(edges(spark).limit(0), model).collect() == []


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    held = toxicity.remainder(F.col("doc_id"), 5) == 0
    model = language.train(docs, ~held)
    assert model.languages == ("de", "en", "es", "fr")
    got = language.predict(docs, model).filter(held).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.99
    odd = language.predict(edges(spark), model).collect()
    by = {r.doc_id: r for r in odd}
    assert len(odd) == len(EDGES) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900_001, 900_002, 900_003))
    assert by[900_004].lang_pred == "en" and 0 < by[900_004].score <= 1


def test_language_against_plain_sums(spark):
    rows = [(1, "aab", "x"), (2, "abc abc", "x"), (3, "ccd", "y"), (4, "ddd c", "y"), (5, "abd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    counts = {}
    for _, text, lang in rows[:4]:
        own = counts.setdefault(lang, np.zeros(1 << language.FEATURE_BITS))
        for x in language._features(text):
            np.add.at(own, x, 1)
    for row in language.predict(docs, model).collect():
        x = np.concatenate(list(language._features(dict((i, t) for i, t, _ in rows)[row.doc_id])))
        total = {k: np.log(0.5) + np.log((v[x] + 0.5) / (v + 0.5).sum()).sum() for k, v in counts.items()}
        best = max(total, key=total.get)
        assert row.lang_pred == best and row.score == pytest.approx(1 / sum(np.exp(t - total[best]) for t in total.values()), rel=1e-3)


def test_rare_languages_stay(spark):
    rows = [(i, f"the word {i} here", "en") for i in range(3000)] + [(5000, "zzq qzz xqx", "xx"), (5001, "qzx zzq", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.train(docs, most=200)
    assert model.languages == ("en", "xx") and np.exp(model.prior) == pytest.approx([3000 / 3002, 2 / 3002])
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert got[5000] == got[5001] == "xx" and got[17] == "en"
    many = docs.withColumn("lang", F.col("doc_id").cast("string"))
    with pytest.raises(ValueError, match="different languages"):
        language.train(many)


def plain_ngrams(text):
    """Features of all runs of 1 to 3 characters, by the same hash."""
    m, found = (1 << 32) - 1, []
    points = [ord(c) for c in text.lower()]
    for n in (1, 2, 3):
        for at in range(len(points) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x01000193 + points[at + k] + k + 1) & m
            h = h * 0x9E3779B1 & m
            found.append(((h ^ h >> 16) * 0x85EBCA6B & m) >> 32 - language.FEATURE_BITS)
    return found


def test_ngrams_and_batches(monkeypatch):
    texts = ["", "a", "Ab", "straße ÀÉ 中文", "abc " * 50, "x" * 3000]
    for text in texts:
        assert sorted(np.concatenate([np.zeros(0, int), *language._features(text)]).tolist()) == sorted(plain_ngrams(text))
    rng = np.random.default_rng(5)
    log_p = rng.normal(size=(1 << language.FEATURE_BITS, 3)).astype(np.float32)
    model = language.Model(("a", "b", "c"), np.array([0.1, 0.2, 0.3]), log_p)
    want = [model.prior + sum((log_p[x].astype(float) for x in plain_ngrams(t)), np.zeros(3)) for t in texts]
    for most in (1 << 20, 64):
        monkeypatch.setattr(language, "CHARACTERS_AT_ONCE", most)
        assert language.posteriors(texts, model) == pytest.approx(np.array(want), rel=1e-5, abs=1e-4)


def test_language_without_rows(spark):
    docs = edges(spark).withColumn("lang", F.lit(None).cast("string"))
    model = language.train(docs)
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).collect() == []
