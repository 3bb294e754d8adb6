"""Similarity operators and the queries that SQL cannot express, against plain Python."""

import difflib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantorium.functions import lexical
from cantorium.functions.encoder import hashed_ngrams
from cantorium.operators import candidates, graph, homogeneity, knn, pairs, provenance, tables
from cantorium.plans import registry, similarity
from cantorium.session import table

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def unit(x):
    x = np.asarray(x, float)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def grams(text):
    bare = "".join((text or "").split(" ")).replace("\n", "").replace("\t", "")
    return {bare[i : i + 2] for i in range(len(bare) - 1)} or ({bare} if bare else set())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["moon", "river", "sea", "cloud", "a", "of", "the", "night", "x"]
    make = lambda n: " ".join(rng.choices(words, k=n))
    corpus = [(i, make(rng.randint(0, 40))) for i in range(120)] + [(500, None), (501, ""), (502, "m"), (503, "moon river"), (504, "moon river")]
    asked = [(i, make(rng.randint(1, 9))) for i in range(12)] + [(90, ""), (91, None), (92, "m"), (93, "zz")]
    return asked, corpus, spark.createDataFrame(asked, "query_id long, text string").repartition(3), spark.createDataFrame(corpus, "corpus_id long, text string").repartition(4)


def plain_candidates(asked, corpus, k, frequent=None):
    often = set()
    if frequent is not None:
        counts = {}
        for _, t in corpus:
            for g in grams(t):
                counts[g] = counts.get(g, 0) + 1
        often = {g for g, n in counts.items() if n > frequent * len(corpus)}
    out = {}
    for q, t in asked:
        found = sorted((-len((grams(t) & grams(c)) - often), i) for i, c in corpus)
        out |= {(q, i): (-n, r + 1) for r, (n, i) in enumerate(found[:k]) if n}
    return out


@pytest.mark.parametrize("frequent", [None, 0.5])
def test_candidates_both_ways(spark, monkeypatch, texts, frequent):
    asked, corpus, left, right = texts
    want = plain_candidates(asked, corpus, 7, frequent)
    got = lambda: {(r.query_id, r.corpus_id): (r.shared, r.rank) for r in candidates.ngram_candidates(left, right, 7, frequent=frequent).collect()}
    assert got() == want
    monkeypatch.setattr(candidates, "TEXTS", 5)
    assert got() == want
    monkeypatch.setattr(candidates, "MOST_QUERIES", 3)  # by posting lists
    assert got() == want


def test_rerank_and_best_are_exact(spark, monkeypatch, texts):
    asked, corpus, left, right = texts
    every = left.select("query_id").crossJoin(right.select("corpus_id"))
    got = {}
    for r in candidates.rerank(every, left, right, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.corpus_id))
    for q, t in asked:
        best = sorted((-ratio(t, c), i) for i, c in corpus)[:3]
        assert sorted(got[q]) == [(n + 1, pytest.approx(-s), i) for n, (s, i) in enumerate(best)]
    one = {r.query_id: r.corpus_id for r in candidates.lexical_best(left, right).collect()}
    assert one == {q: min((-ratio(t, c), i) for i, c in corpus)[1] for q, t in asked}
    monkeypatch.setattr(candidates, "MOST_PAIRS", 10)
    with pytest.raises(ValueError, match="pairs"):
        candidates.lexical_best(left, right)


def test_merge_takes_semantic_candidates_first(spark):
    frame = lambda rows: spark.createDataFrame(rows, "query_id long, corpus_id long, rank int")
    queries, corpus = spark.createDataFrame([(1,), (2,)], "query_id long"), spark.createDataFrame([(i,) for i in range(9)], "corpus_id long")
    got = candidates.merge_candidates(frame([(1, 5, 1), (1, 7, 2)]), frame([(1, 7, 1), (1, 3, 2), (1, 4, 3)]), queries, corpus, 3).collect()
    assert sorted((r.query_id, r.place, r.corpus_id) for r in got) == [(1, 1, 5), (1, 2, 7), (1, 3, 3), (2, 1, 0), (2, 2, 1), (2, 3, 2)]


@pytest.mark.parametrize("part", [2048, 7])
def test_pairs_and_neighbours_against_all(spark, monkeypatch, part):
    monkeypatch.setattr(pairs, "PART", part)
    monkeypatch.setattr(knn, "CORPUS_BLOCK", 4 * part)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x[7] = x[3]
    x[9] = x[3]
    rows = [(i, ["a", "b", None][i % 3], v) for i, v in enumerate(x.tolist())] + [(99, "a", None)]
    df = spark.createDataFrame(rows, "i long, g string, v array<double>").repartition(4)
    sims = unit(x) @ unit(x).T
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if sims[a, b] >= 0.5}
    assert {(r.i_a, r.i_b) for r in pairs.cosine_pairs(df, [], "i", "v", 0.5).collect()} == want
    got = {(r.g, r.i_a, r.i_b): r.cosine for r in pairs.cosine_pairs(df, ["g"], "i", "v").collect()}
    own = {(rows[a][1], a, b): sims[a, b] for a in range(60) for b in range(a + 1, 60) if rows[a][1] == rows[b][1] and rows[a][1]}
    assert got == pytest.approx(own)
    some = df.filter("v is not null")
    near = knn.top_k(some.select(F.col("i").alias("query_id"), "v"), some.select(F.col("i").alias("corpus_id"), "v"), 4, skip_same=True).collect()
    best = {(q, k + 1): c for q in range(60) for k, c in enumerate(sorted((c for c in range(60) if c != q), key=lambda c: (-round(sims[q, c], 12), c))[:4])}
    assert {(r.query_id, r.rank): r.corpus_id for r in near} == best


def test_communities_of_small_and_large_graphs(spark, monkeypatch):
    clique = lambda nodes: [(a, b, 1.0) for a in nodes for b in nodes if a < b]
    rows = [("s", *e) for e in clique([5, 1, 9]) + clique([20, 30, 40]) + [(9, 20, 0.1)]]
    edges = spark.createDataFrame(rows, "scope string, src long, dst long, weight double")
    nodes = spark.createDataFrame([("s", n) for n in (1, 5, 9, 20, 30, 40, 77, 78)] + [("t", 3)], "scope string, node long")
    want = {("s", n): c for c, own in ((1, (1, 5, 9)), (20, (20, 30, 40))) for n in own} | {("s", 77): -1, ("s", 78): -1, ("t", 3): -1}
    assert {(r.scope, r.node): r.community for r in graph.communities(edges, nodes).collect()} == want
    assert {(r.scope, r.node): r.community for r in graph.communities(edges, nodes, most=2).collect()} == want


def test_a_change_replaces_its_row_as_a_whole(spark):
    rows = spark.createDataFrame([(1, "o", "o"), (2, "o", "o"), (3, "o", "o")], "k int, x string, y string")
    changes = spark.createDataFrame([(1, "z", "a"), (1, "a", "z"), (3, None, "n")], "k int, x string, y string")
    got = {r.k: (r.x, r.y) for r in tables.update_by_key(rows, changes, "k", ["x", "y"]).collect()}
    assert got == {1: ("z", "a"), 2: ("o", "o"), 3: (None, "n")}


def test_profile_of_two_channels(spark):
    rows = [(1, 0, 7, 0.5, 7, 0.25), (1, 1, 7, 0.75, None, None), (1, 2, None, None, 8, 0.5), (1, 3, 9, 0.9, 9, 1.0), (1, 4, 9, 0.1, 8, 0.0), (2, 0, None, None, None, None)]
    parts = spark.createDataFrame(rows, "k int, o int, sem_source long, sem_score double, lex_source long, lex_score double")
    got = {r.k: r for r in provenance.profile(parts, "k", "o").collect()}
    r = got[1]
    assert (r.sentence_count, r.same_source_sentence_count, r.sem_dominant_source, r.sem_dominant_coverage, r.distinct_sem_sources, r.longest_sem_run) == (5, 2, 7, 0.4, 2, 2)
    assert (r.lex_dominant_source, r.lex_dominant_coverage, r.distinct_lex_sources, r.longest_lex_run, r.max_sentence_lex_score) == (8, 0.4, 3, 1, 1.0)
    assert r.mean_sentence_sem_score == pytest.approx(2.25 / 5) and got[2].sem_dominant_source is None and got[2].sem_dominant_coverage == 0
    named = provenance.attribute(spark.createDataFrame([(1, 7), (2, None)], "k int, s long"), spark.createDataFrame([(7, "t")], "source_id long, title string"), "s", ["title"])
    assert {r.k: r.s_title for r in named.collect()} == {1: "t", 2: None}


def test_sentence_measures_against_loops():
    rng, encode = random.Random(2), hashed_ngrams()()
    sentences = [(n, " ".join(rng.choices(["moon", "sea", "night", "of", "river"], k=rng.randint(1, 5)))) for n in (4, 6, 9) for _ in range(rng.randint(2, 6))]
    rows = [(n, t, encode([t])[0]) for n, t in sentences]
    got = homogeneity.sentence_measures(rows, 3, 0.85, 0.3)
    tops = []
    for a, b in ((4, 6), (4, 9), (6, 9)):
        found = [(float(unit(u) @ unit(v)), ratio(s, t)) for n, s, u in rows if n == a for m, t, v in rows if m == b]
        found = sorted(found, key=lambda x: -round(x[0], 9))[:3]
        tops.append((found[0][0], sum(s for s, _ in found) / 3, sum(s >= 0.85 for s, _ in found) / 3, sum(s - x > 0.3 for s, x in found) / 3))
    names = ("top1_sent_mean", "topk_sent_mean", "sent_highsim_ratio", "sent_pseudo_ratio")
    assert [got[n] for n in names] == pytest.approx(np.array(tops).mean(0).tolist()) and got["sentence_pair_count"] == 3
    assert homogeneity.sentence_measures(rows[:1], 3, 0.85, 0.3)["top1_sent_mean"] == 0


def test_suspicion_report_against_loops(spark):
    vectors = {r.vec_id: (unit(r.embedding), r.label) for r in table(spark, SF, "embeddings").collect()}
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = {r.query_id: r for r in registry.QUERIES["suspicion_report"](spark, SF).collect()}
    assert set(rows) == {i for i in vectors if i % 5 == 0}
    for q in sorted(rows)[:12]:
        cosine, i = max((float(vectors[q][0] @ vectors[c][0]), -c) for c in vectors if c % 5)
        r, lexical = rows[q], ratio(docs.get(q), docs.get(-i))
        assert (r.corpus_id, r.cross_label) == (-i, vectors[q][1] != vectors[-i][1])
        assert [r.cosine, r.lexical, r.threat] == pytest.approx([cosine, lexical, max(cosine, 2 * lexical)], abs=2e-6)
        assert r.suspicious == (cosine >= 0.82 or lexical >= 0.35)


def test_intra_text_similarity_against_loops(spark):
    encode, turns = hashed_ngrams()(), {}
    for r in table(spark, SF, "conversations").collect():
        turns.setdefault(r.conv_id, {})[r.turn] = r.text
    rows = {r.conv_id: r for r in registry.QUERIES["intra_text_similarity"](spark, SF).collect()}
    assert set(rows) == {c for c, own in turns.items() if len(own) > 1}
    for c in sorted(rows)[:8]:
        own = [t for _, t in sorted(turns[c].items())]
        v = unit(np.float32(encode([t or "" for t in own])))
        both = [(float(v[a] @ v[b]), ratio(own[a], own[b])) for a in range(len(own)) for b in range(a + 1, len(own))]
        sem, lex = zip(*both)
        r = rows[c]
        assert [r.avg_sem, r.max_sem, r.avg_lex, r.max_lex] == pytest.approx([sum(sem) / len(sem), max(sem), sum(lex) / len(lex), max(lex)], abs=1e-5)


def test_seq_ratio_query_ranks_its_candidates(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    asked = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    rows = registry.QUERIES["seq_ratio_topk_candidates"](spark, SF).collect()
    assert len(rows) == 3 * len(asked) and similarity.MOST_CANDIDATES < len(docs)
    for r in rows[:30]:
        assert r.score == pytest.approx(ratio(asked[r.query_id], docs[r.corpus_id]), abs=2e-6)


def test_homogeneity_summary_against_loops(spark):
    encode = hashed_ngrams()()
    docs = [r for r in table(spark, SF, "documents").collect()]
    kind = {r.doc_id: f"q{r.quality}t{r.toxic}" for r in table(spark, SF, "labels").collect()}
    import hashlib

    got = {r.source: r for r in registry.QUERIES["homogeneity_summary"](spark, SF).collect()}
    for source in sorted(got)[:3]:
        own, rounds = [d for d in docs if d.source == source], []
        for n in range(similarity.ROUNDS):
            drawn = sorted(own, key=lambda d: (hashlib.md5(f"42|{source}|{n}|{d.doc_id}".encode()).hexdigest(), d.doc_id))[: similarity.SAMPLED]
            drawn.sort(key=lambda d: d.doc_id)
            v = unit(np.float32(encode([d.text or "" for d in drawn])))
            both = [(float(v[a] @ v[b]), ratio(drawn[a].text, drawn[b].text)) for a in range(len(drawn)) for b in range(a + 1, len(drawn))]
            kinds = [kind[d.doc_id] for d in drawn if d.doc_id in kind]
            shares = np.array([kinds.count(k) for k in set(kinds)]) / max(len(kinds), 1)
            entropy = float(-(shares * np.log2(shares)).sum() / np.log2(len(shares))) if len(shares) > 1 else 0.0
            sem, lex = map(np.array, zip(*both))
            rounds.append((np.percentile(sem, 50), np.percentile(lex, 90), (sem - lex > 0.3).mean(), entropy, len(set(kinds))))
        want, r = np.array(rounds).mean(0), got[source]
        assert [r.whole_sem_p50, r.whole_lex_p90, r.whole_pseudo_ratio, r.category_entropy, r.distinct_category_count] == pytest.approx(want.tolist(), abs=1e-5)


def test_machine_local_folder_only_in_local_sessions():
    from cantorium.session import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_hidden_connections_against_loops(spark):
    vectors = {r.vec_id: (unit(r.embedding), r.label) for r in table(spark, SF, "embeddings").collect()}
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    ids = sorted(set(vectors) & set(docs))
    want = {}
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            if vectors[a][1] == vectors[b][1]:
                cosine = float(vectors[a][0] @ vectors[b][0])
                if cosine >= 0.3 and ratio(docs[a], docs[b]) <= 0.45:
                    want[a, b] = (cosine, ratio(docs[a], docs[b]))
    rows = registry.QUERIES["hidden_connections"](spark, SF).collect()
    assert {(r.vec_id_a, r.vec_id_b) for r in rows} == set(want)
    assert all([r.cosine, r.lexical] == pytest.approx(want[r.vec_id_a, r.vec_id_b], abs=2e-6) for r in rows)
    gaps = [r.cosine - r.lexical for r in rows]
    assert all(x >= y - 3e-6 for x, y in zip(gaps, gaps[1:]))


def plain_overlap(a, b):
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.85
    return max(len(set(a) & set(b)) / len(set(a) | set(b)), ratio(a, b))


def test_soft_jaccard_pairs_against_loops(spark):
    turns = {}
    for r in table(spark, SF, "conversations").collect():
        words = sorted({w for w in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()})
        turns.setdefault(r.conv_id, {})[r.turn] = words
    rows = registry.QUERIES["soft_jaccard_pairs"](spark, SF).collect()
    assert len(rows) == sum(len(t) * (len(t) - 1) // 2 for t in turns.values())
    for r in rows[:25]:
        left, rest, matched = turns[r.conv_id][r.turn_a], list(turns[r.conv_id][r.turn_b]), 0
        total = len(left) + len(rest)
        for word in left if rest else []:
            scores = [plain_overlap(word, other) for other in rest]
            if scores and max(scores) >= 0.67:
                rest.pop(scores.index(max(scores)))
                matched += 1
        assert r.similarity == pytest.approx(matched / (total - matched) if matched else 0.0, abs=2e-6)


def test_provenance_profile_against_loops(spark):
    encode = hashed_ngrams()()
    docs = [r for r in table(spark, SF, "documents").collect()]
    asked = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    rows = {r.item_id: r for r in registry.QUERIES["provenance_profile"](spark, SF).collect()}
    assert set(rows) == set(asked)
    vectors = unit(np.float32(encode([d.text or "" for d in docs])))
    split = lambda t: [s for s in (p.strip() for p in re.split(r"[,.!?;\n]", t)) if s]
    by_id = {d.doc_id: d for d in docs}
    sentences = [(d.doc_id, s) for d in docs for s in split(d.text or "")]
    sentence_vectors = unit(np.float32(encode([s for _, s in sentences])))
    for item in sorted(rows)[:6]:
        r, sims = rows[item], vectors @ unit(np.float32(encode([asked[item]])))[0]
        assert r.whole_sem_score == pytest.approx(float(sims.max()), abs=1e-5) and sims[[d.doc_id for d in docs].index(r.whole_sem_source)] == pytest.approx(float(sims.max()), abs=1e-5)
        assert r.whole_sem_source_author == by_id[r.whole_sem_source].source and r.whole_sem_source_title == by_id[r.whole_sem_source].lang
        assert r.whole_lex_score == pytest.approx(ratio(asked[item], by_id[r.whole_lex_source].text), abs=2e-6) and 0 <= r.whole_sem_percentile <= 1
        parts = split(asked[item])
        best = (sentence_vectors @ unit(np.float32(encode(parts))).T).max(0)
        assert r.sentence_count == len(parts) and r.max_sentence_sem_score == pytest.approx(float(best.max()), abs=1e-5)
        assert r.mean_sentence_sem_score == pytest.approx(float(best.mean()), abs=1e-5)
    first = rows[min(rows)]
    assert first.max_sentence_lex_score <= max(ratio(p, s) for p in split(asked[min(rows)]) for _, s in sentences) + 1e-6


def dealt(spark, monkeypatch, n=230, dimensions=5):
    """Vectors of two blocks in several small parts, with their cosines by block and pair; a vector without numbers is in no pair."""
    for name, value in {"PART": 40, "TEXT_PART": 40, "LEAST_PART": 20, "ROWS": 7, "BATCH": 50}.items():
        monkeypatch.setattr(pairs, name, value)
    x = np.random.default_rng(3).normal(size=(n, dimensions)).astype(np.float32)
    rows = [("g" if i % 3 else "h", i, x[i].tolist(), f"text {i % 11} of {i % 7}" * 9) for i in range(n)]
    df = spark.createDataFrame([*rows, ("g", 900, [float("nan")] * dimensions, ""), ("g", 901, None, "")], "g string, i long, v array<float>, t string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(rows[a][0], a, b): float(u[a] @ u[b]) for a in range(n) for b in range(a + 1, n) if rows[a][0] == rows[b][0]}
    return df, want, {i: t for _, i, _, t in rows}


def test_pairs_of_parts_against_loops(spark, monkeypatch):
    df, want, texts = dealt(spark, monkeypatch)
    found = pairs.cosine_pairs(df, ["g"], "i", "v", 0.3).collect()
    assert sorted((r.g, r.i_a, r.i_b) for r in found) == sorted(k for k, c in want.items() if c >= 0.3)
    assert all(r.cosine == pytest.approx(want[r.g, r.i_a, r.i_b]) for r in found)
    asked, corpus = df.filter("i % 5 = 0").withColumnRenamed("i", "q"), df.filter("i % 5 <> 0").withColumnRenamed("i", "c")
    between = pairs.cosine_between(asked, corpus, ["g"], "q", "c", "v", 0.2).collect()
    expected = [(g, a, b) if a % 5 == 0 else (g, b, a) for (g, a, b), c in want.items() if c >= 0.2 and (a % 5 == 0) != (b % 5 == 0)]
    assert sorted((r.g, r.q, r.c) for r in between) == sorted(expected)
    hidden = pairs.hidden_pairs(df, ["g"], "i", "v", "t", 0.3, 0.9).collect()
    plain = {k: difflib.SequenceMatcher(None, texts[k[1]], texts[k[2]]).ratio() for k, c in want.items() if c >= 0.3}
    assert {(r.g, r.i_a, r.i_b): r.lexical for r in hidden} == {k: x for k, x in plain.items() if x <= 0.9} and len(hidden) < len(plain)


def test_measures_of_all_cosines_leave_a_task_as_few_rows(spark, monkeypatch):
    df, want, _ = dealt(spark, monkeypatch)
    monkeypatch.setattr(pairs, "MOST_VALUES", 10)  # so that bins are made finer
    strongest = sorted(((g, a, b, c) for (g, a, b), c in want.items()), key=lambda r: (-r[3], r[1], r[2]))[:9]
    top = pairs.top_pairs(df, ["g"], "i", "v", 9)
    assert [(r.src, r.dst) for r in pairs.edges(top, "i_a", "i_b", "cosine", 9).collect()] == [r[1:3] for r in strongest] and top.count() <= 9 * 70
    cuts = {r.g: r for r in pairs.cosine_cuts(df, ["g"], "i", "v", [0, 50, 90, 100], 0.8).collect()}
    told = {r.g: r for r in pairs.cosine_statistics(df, ["g"], "i", "v", 0.2).collect()}
    codes = pairs.tally(df, ["g"], "i", "v", lambda v: np.floor(v * 10).astype(np.int64), -10, 10).groupBy("g").pivot("code").sum("n").collect()
    for g in "gh":
        v = np.array([c for k, c in want.items() if k[0] == g])
        assert [cuts[g].pairs, *cuts[g][2:6], cuts[g].share] == pytest.approx([len(v), *np.percentile(v, [0, 50, 90, 100]), (v >= 0.8).mean()])
        assert list(told[g][1:]) == pytest.approx([len(v), v.mean(), v.max(), v.min(), (v >= 0.2).mean()])
        assert sum(x or 0 for r in codes if r.g == g for x in r[1:]) == len(v)


def test_ratio_is_difflibs():
    rng = random.Random(5)
    for n in range(600):
        letters = rng.choice(["ab", "abcdefgh ", "xyzé漢\U0001f600", "abcdefghijklmnopqrstuvwxyzABC. "])
        a = "".join(rng.choices(letters, k=rng.choice([0, 1, 40, 90, 250, 420])))
        b = a[rng.randrange(9) :] + "!" if n % 9 == 0 else "".join(rng.choices(letters, k=rng.choice([0, 1, 40, 90, 199, 200, 330])))
        assert lexical.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=30_000)) + "Q1"
    other = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=30_000)) + "Q2"
    before = time.perf_counter()
    for _ in range(20):
        lexical.ratio(long, other)
    assert time.perf_counter() - before < 2


def test_measures_of_texts_by_parts(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TOKEN_PART", 9)
    monkeypatch.setattr(pairs, "TURNS", 9)
    monkeypatch.setattr(pairs, "FEW", 4)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.choice([1, 3, 5, 6, 7, 70])))
    words = [word() for _ in range(60)] + ["a" * 90, "ab" * 40]
    rows = [(c, t, sorted(set(rng.sample(words, rng.randint(0, 12)))), rng.random(), rng.random()) for c in (1, 2) for t in range(25 if c == 1 else 3)]
    df = spark.createDataFrame([(c, t, w, " ".join(w), [x, y]) for c, t, w, x, y in rows], "c long, t long, w array<string>, s string, v array<double>")
    both = {(c, t, u): (w, x) for c, t, w, *_ in rows for d, u, x, *_ in rows if c == d and t < u}
    found = pairs.soft_jaccard_pairs(df, ["c"], "t", "w").collect()
    assert {(r.c, r.t_a, r.t_b): r.similarity for r in found} == {k: lexical.soft_jaccard(a, b) for k, (a, b) in both.items()} and len(found) == len(both)
    told = {r.c: r for r in pairs.text_measures(df, ["c"], "t", "v", "s").collect()}
    for c in (1, 2):
        lex = [ratio(" ".join(a), " ".join(b)) for k, (a, b) in both.items() if k[0] == c]
        assert (told[c].pairs, told[c].avg_lex, told[c].max_lex) == (len(lex), pytest.approx(np.mean(lex)), max(lex))


def test_neighbours_and_grams_are_met_where_texts_are_read(spark, monkeypatch):
    """a corpus of many copies is neither dealt out nor written; ties go to the smaller ids, by either way."""
    rng = random.Random(7)
    different = ["".join(rng.choice("abcde \u6f22\U0001f600") for _ in range(rng.randint(0, 9))) for _ in range(30)]
    rows = [(i, rng.choice(different)) for i in range(200)] + [(900, None)]
    corpus = spark.createDataFrame(rows, "corpus_id long, text string").repartition(3)
    encode = hashed_ngrams(16)()
    x = unit(encode([t for _, t in rows]).astype(np.float32).astype(float))
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 60, 3)], "query_id long, v array<double>")
    sims = np.round(x[range(0, 60, 3)] @ x.T, 12)
    want = {(q, r + 1): rows[c][0] for q, s in zip(range(0, 60, 3), sims) for r, c in enumerate(sorted((c for c in range(len(rows)) if rows[c][0] != q), key=lambda c: (-s[c], rows[c][0]))[:9])}
    found = knn.top_k(asked, corpus, 9, skip_same=True, load=hashed_ngrams(16))
    assert {(r.query_id, r.rank): r.corpus_id for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    monkeypatch.setattr(knn, "WAITING", 10)
    monkeypatch.setattr(knn, "CELLS", 50)
    assert {(r.query_id, r.rank): r.corpus_id for r in knn.top_k(asked, corpus, 9, skip_same=True, load=hashed_ngrams(16)).collect()} == want
    texts = [(i, t) for i, t in enumerate(different)]
    near = candidates.ngram_candidates(spark.createDataFrame(texts, "query_id long, text string"), corpus, 5).collect()
    assert {(r.query_id, r.corpus_id): (r.shared, r.rank) for r in near} == plain_candidates(texts, rows, 5)
    of, index = [], candidates.GramIndex({g: i for i, g in enumerate(sorted(grams(different[3]) | grams(different[5])))}, 2, 7)
    for many, known in index.of([t for _, t in rows]):
        of += [len(k) for k in np.split(known, np.cumsum(many)[:-1])]
    assert of == [len(grams(t) & (grams(different[3]) | grams(different[5]))) for _, t in rows]


def test_a_row_goes_to_few_parts(spark, monkeypatch):
    """parts hold as many rows as their vectors' components allow, and cosines are held piece by piece."""
    count = lambda dimensions, rows: spark.range(rows).select(F.lit([0.0] * dimensions).alias("__v")).agg(pairs._parts(pairs.PART).alias("n")).first().n
    assert count(2, 400_000) == 7 and count(2, 100_000) == pairs.PARTS  # 25 and 7 with 16,384 rows
    monkeypatch.setattr(pairs, "COMPONENTS", 3000)
    assert count(3, 20_000) == 20 and count(30, 2000) == 20
    rng = np.random.default_rng(2)
    side = pairs.Side.__new__(pairs.Side)
    side.ids, side.x = np.arange(300), unit(rng.normal(size=(300, 4)))
    monkeypatch.setattr(pairs, "CELLS", 700)
    met = pairs.Meeting(side, side)
    assert max(v.size for _, _, v, _ in met._products()) <= 700
    assert sum(len(i) for i, _, _ in met.found(-np.inf)) == 300 * 299 // 2
    monkeypatch.setattr(pairs, "PART", 9)  # heeded where rows meet
    monkeypatch.setattr(pairs, "PARTS", 1)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(side.x[:40].tolist())], "i long, v array<double>")
    sims = side.x[:40] @ side.x[:40].T
    assert {(r.i_a, r.i_b) for r in pairs.cosine_pairs(df, [], "i", "v", 0.5).collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40) if sims[a, b] >= 0.5}
