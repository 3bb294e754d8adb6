"""Fingerprints, links and classes against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from cantorium.llm import components, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    for c in "\t\n\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(3)
    texts = [None, "", " \n", "A", "a B", "É é\x1cx \x85 ß", "a b c " * 30000] + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 900))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("compared", [simhash.COMPARED, 4])
def test_links_span_the_exact_classes(spark, monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = random.Random(4)
    nodes = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        nodes |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(90)}
    nodes |= {n ^ 3 << 63 & (1 << 64) - 1 for n in list(nodes)[:20]}
    nodes = sorted(nodes)
    linked = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= 2]
    signed = [n - (1 << 64) if n >> 63 else n for n in nodes]
    keyed = spark.createDataFrame([(n,) for n in signed], "fp long").select("fp", *[k.alias(f"k{i}") for i, k in enumerate(simhash.keys(simhash.F.col("fp")))]).collect()
    rows = sorted((r[i + 1], r.fp & (1 << 64) - 1) for r in keyed for i in range(16))
    found = []
    for at in range(0, len(rows), 37):  # small batches, so buckets cross them
        found.append(pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[at : at + 37]], pa.int64()), pa.array([f - (1 << 64) if f >> 63 else f for _, f in rows[at : at + 37]], pa.int64())], ["key", "fp"]))
    mask = (1 << 64) - 1
    got = [(a & mask, b & mask) for batch in simhash.link_buckets(iter(found)) for a, b in zip(*(c.to_pylist() for c in batch.columns))]
    assert all((a ^ b).bit_count() <= 2 or compared == 4 or plain_components(nodes, linked)[a] == plain_components(nodes, linked)[b] for a, b in got)
    assert plain_components(nodes, got) == plain_components(nodes, linked)


def test_chain_budgets():
    rng = random.Random(8)
    for _ in range(3000):
        apart = sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 3, 4, 9, 64])))
        counts = [(apart >> 56 - 8 * k & 255).bit_count() for k in range(8)]
        chains = []
        for start in range(8):
            chain = [counts[(start + k) % 8] for k in range(8)]
            chains.append(all(sum(chain[:n]) * 8 <= n * 2 for n in range(1, 9)))
            assert bool(simhash.in_chain(np.array([apart], np.uint64), start)[0]) == chains[-1]
        assert any(chains) == (apart.bit_count() <= 2)


def test_links_refuses_what_its_keys_do_not_cover(spark):
    with pytest.raises(ValueError, match="0 to 2"):
        simhash.links(spark.createDataFrame([], "fp long"), 3)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(-50, 400), rng.randint(-50, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == plain_components(nodes, [p for p in pairs if p[0] != p[1]])
    assert components.components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_classes_and_drop(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choices(["ab", "cd", "ef", "gh", "ij", "kl"], k=200)) for _ in range(30)]
    texts = base + [b + " tail" for b in base] + base[:5] + [None, "", "  "]
    rows = [(i, t, "f", "c") for i, t in enumerate(texts)] + [(2, texts[2], "f", "c"), (None, base[0], "f", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root string").repartition(4)
    prints = {i: plain_fingerprint(t) for i, t, *_ in rows if i is not None}
    want = plain_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = simhash.classes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[0 if r.doc_id is None else r.doc_id]
    kept = simhash.drop_duplicates(docs).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == sorted([-1, *{want[i] for i in prints}])
    assert kept[0].__fields__ == docs.columns and simhash.classes(docs.limit(0)).collect() == []


def test_drop_keeps_different_texts_under_one_id(spark):
    rng = random.Random(7)
    a, b, c = (" ".join(rng.choices(["ab", "cd", "ef", "gh", "ij", "kl"], k=200)) for _ in range(3))
    upper = a.upper()  # the same fingerprint
    docs = spark.createDataFrame([(1, a), (1, upper), (1, b), (1, b), (2, b), (2, c)], "doc_id int, text string").withColumn("tags", F.create_map(F.lit("k"), F.lit(1))).repartition(3)
    kept = simhash.drop_duplicates(docs).collect()
    assert sorted((r.doc_id, r.text.lower()) for r in kept) == sorted([(1, a), (1, b), (2, c)])
