"""Similarity queries: vectors of the embeddings table, documents against the benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantorium.functions import stats
from cantorium.functions.encoder import encode_column, hashed_ngrams
from cantorium.functions.text import LATIN_SENTENCE_MARKS, chars, sentences
from cantorium.operators import candidates, graph, homogeneity, knn, pairs, provenance, scores
from cantorium.operators import descriptive as D
from cantorium.plans.common import documents, query, six, words
from cantorium.session import materialize, table

_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
_PAIRS = f"select a.label, a.vec_id as vec_id_a, b.vec_id as vec_id_b, {_COS} as cosine from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id"


def _pairs(spark, sf_dir, least=None):
    return pairs.cosine_pairs(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", least)


@query(f"select label, vec_id_a, vec_id_b, round(cosine, 6) as cosine from ({_PAIRS}) where cosine >= 0.25")
def cosine_pairs_within_group(spark, sf_dir):
    return _pairs(spark, sf_dir, 0.25).withColumn("cosine", six("cosine"))


@query(f"select label, count(*) as pairs, round(avg(cosine), 6) as mean, round(max(cosine), 6) as most, round(min(cosine), 6) as least, round(avg((cosine >= 0.2)::int), 6) as high_share from ({_PAIRS}) group by label")
def pair_stats_by_group(spark, sf_dir):
    found = pairs.cosine_statistics(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 0.2)
    return found.select("label", "pairs", *[six(c).alias(c) for c in ("mean", "most", "least", "high_share")])


@query(f"""
with c as (select label, least(trunc(cosine / (1.0::double / 20))::int, 19) as bin, count(*) as n from ({_PAIRS}) group by all), p as (select *, n / sum(n) over (partition by label) as p from c)
select label, round(-sum(p * log2(p)) / log2(20), 6) as binned_entropy from p group by label""")
def binned_entropy(spark, sf_dir):
    return pairs.cosine_entropy(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding").withColumn("binned_entropy", six("binned_entropy"))


_KNN = f"""
with p as (select a.vec_id as query_id, b.vec_id as corpus_id, {_COS} as cosine from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by cosine desc, corpus_id)::int as rank from p)"""


def _neighbours(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return knn.top_k(asked, vectors.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("v")), k, skip_same=True)


@query(f"{_KNN} select query_id, corpus_id, rank, round(cosine, 6) as cosine from r where rank <= 5")
def knn_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir, 5).withColumn("cosine", six("cosine"))


@query(f"""{_KNN}
select count(*) as n, round(avg(cosine), 6) as mean, round(quantile_cont(cosine, 0.5), 6) as p50, round(quantile_cont(cosine, 0.9), 6) as p90, round(quantile_cont(cosine, 0.95), 6) as p95,
  round(quantile_cont(cosine, 0.99), 6) as p99, round(max(cosine), 6) as max from r where rank = 1""")
def nearest_neighbour_baseline(spark, sf_dir):
    found = _neighbours(spark, sf_dir, 1).agg(*stats.summary(F.col("cosine")))
    return found.select("n", *[six(c).alias(c) for c in found.columns[1:]])


def _texts(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return passages, documents(spark, sf_dir).select(F.col("doc_id").alias("corpus_id"), "text")


_GRAMS = """
list_distinct(case when length(t) = 0 then [] when length(t) < 2 then [t] else list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) end)"""


@query(f"""
with q as (select item_id as query_id, unnest({_GRAMS}) as gram from (select *, regexp_replace(text, '\\s+', '', 'g') as t from benchmark)),
c as (select doc_id as corpus_id, unnest({_GRAMS}) as gram from (select *, regexp_replace(text, '\\s+', '', 'g') as t from documents)),
s as (select query_id, corpus_id, count(*) as shared from q join c using (gram) group by all),
r as (select *, row_number() over (partition by query_id order by shared desc, corpus_id)::int as rank from s)
select query_id, corpus_id, shared, rank from r where rank <= 10""")
def char_bigram_candidates(spark, sf_dir):
    return candidates.ngram_candidates(*_texts(spark, sf_dir), 10)


#: Candidates of a text: so many by meaning first, then by n-grams up to so many.
SEMANTIC, MOST_CANDIDATES = 64, 160


def _vectors(df, key):
    return df.select(key, encode_column(F.col("text"), hashed_ngrams()).alias("v"))


def _candidates(asked, corpus, asked_vectors, corpus_vectors=None):
    """Semantic candidates, then those that share most bigrams. Without its vectors the corpus is encoded where it is met."""
    semantic = knn.top_k(asked_vectors, corpus if corpus_vectors is None else corpus_vectors, SEMANTIC, load=hashed_ngrams() if corpus_vectors is None else None)
    lexical = candidates.ngram_candidates(asked, corpus, MOST_CANDIDATES)
    semantic, lexical = materialize(semantic, "semantic-candidates"), materialize(lexical, "lexical-candidates")
    return semantic, candidates.merge_candidates(semantic, lexical, asked, corpus, MOST_CANDIDATES)


@query()
def seq_ratio_topk_candidates(spark, sf_dir):
    """The documents with the highest sequence ratio among each passage's merged candidates."""
    asked, corpus = _texts(spark, sf_dir)
    _, merged = _candidates(asked, corpus, materialize(_vectors(asked, "query_id"), "passage-vectors"))
    return candidates.rerank(merged, asked, corpus, 3).withColumn("score", six("score"))


@query("""
with t as (select item_id as id, lower(text) as t from benchmark), g as (
  select id, unnest(list_concat(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)), list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))) as gram from t),
tf as (select id, gram, count(*) as tf from g group by all), df as (select gram, count(*) as df from tf group by gram),
w as (select id, gram, tf * (ln((1 + (select count(*) from t)) / (1 + df)) + 1) as w from tf join df using (gram)),
u as (select id, gram, w / sqrt(sum(w * w) over (partition by id)) as w from w)
select a.id as id_a, b.id as id_b, round(sum(a.w * b.w), 6) as cosine from u a join u b on a.gram = b.gram and a.id < b.id group by all having sum(a.w * b.w) >= 0.5""")
def tfidf_char_cosine(spark, sf_dir):
    return candidates.tfidf_pairs(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), 0.5).withColumn("cosine", six("cosine"))


@query("""
with c as (select lang as g, item_id, unnest(list_distinct(string_split(text, ''))) as ch from benchmark, (values ('all')) v(lang)),
s as (select item_id, count(*) as n from c group by all)
select a.item_id as item_id_a, b.item_id as item_id_b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) as jaccard
from c a join c b on a.ch = b.ch and a.item_id < b.item_id join s x on x.item_id = a.item_id join s y on y.item_id = b.item_id group by all""")
def charset_jaccard(spark, sf_dir):
    texts = table(spark, sf_dir, "benchmark").select("item_id", chars(F.col("text")).alias("c"), F.lit("all").alias("scope"))
    found = pairs.within(texts, ["scope"], "item_id", ["c"])
    share = F.size(F.array_intersect("c_a", "c_b")) / F.size(F.array_union("c_a", "c_b"))
    return found.select("item_id_a", "item_id_b", six(share).alias("jaccard"))


@query()
def hidden_connections(spark, sf_dir):
    """Vectors near in meaning whose documents differ in wording; ids tie vectors to documents."""
    told = table(spark, sf_dir, "embeddings").join(documents(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    kept = materialize(pairs.hidden_pairs(told, ["label"], "vec_id", "embedding", "text", 0.3, 0.45), "hidden-pairs")  # sorting reads them twice
    return kept.select("vec_id_a", "vec_id_b", six("cosine").alias("cosine"), six("lexical").alias("lexical")).orderBy(F.desc(F.col("cosine") - F.col("lexical")), "vec_id_a", "vec_id_b")


@query()
def soft_jaccard_pairs(spark, sf_dir):
    """Words of every two turns of a conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(F.array_distinct(words(F.col("text")))).alias("tokens"))
    found = pairs.soft_jaccard_pairs(turns, ["conv_id"], "turn", "tokens")
    return found.select("conv_id", "turn_a", "turn_b", six("similarity").alias("similarity"))


_EDGES = f"select label, vec_id_a as src, vec_id_b as dst, cosine as weight from ({_PAIRS}) order by cosine desc, src, dst limit 300"


def _edges(spark, sf_dir):
    found = pairs.top_pairs(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 300)
    return pairs.edges(found, "vec_id_a", "vec_id_b", "cosine", 300, F.col("label").cast("string"))


@query(f"with e as ({_EDGES}), n as (select src as node, weight from e union all select dst, weight from e) select node, count(*) as degree, round(avg(weight), 5) as mean_weight from n group by node")
def edge_topn_degree(spark, sf_dir):
    return pairs.degrees(_edges(spark, sf_dir)).withColumn("mean_weight", F.round("mean_weight", 5))


@query()
def components(spark, sf_dir):
    """Communities of every label's graph of all pairs at or above a threshold; vectors without an edge are in one further class."""
    label = F.col("label").cast("string")
    found = _pairs(spark, sf_dir, 0.3).select(F.col("vec_id_a").alias("src"), F.col("vec_id_b").alias("dst"), F.col("cosine").alias("weight"), label.alias("scope"))
    return graph.communities(found, table(spark, sf_dir, "embeddings").select(label.alias("scope"), F.col("vec_id").alias("node")))


@query(f"select a.vec_id as vec_id_a, b.vec_id as vec_id_b, round({_COS}, 6) as cosine from embeddings a join embeddings b on a.vec_id < b.vec_id where {_COS} >= 0.4")
def global_pairs(spark, sf_dir):
    """Pairs of all vectors, whatever their label."""
    return pairs.cosine_pairs(table(spark, sf_dir, "embeddings"), [], "vec_id", "embedding", 0.4).withColumn("cosine", six("cosine"))


@query(f"""
with p as ({_PAIRS}), m as (
  select label, count(*) as pairs, quantile_cont(cosine, 0.5) as p50, quantile_cont(cosine, 0.9) as p90, avg((cosine >= 0.85)::int) as high from p group by label)
select label, pairs, round(p50, 6) as whole_sem_p50, round(p90, 6) as whole_sem_p90, round(high, 6) as whole_highsim_ratio, round(0.5 * p50 + 0.3 * p90 + 0.2 * high, 6) as whole_score,
  round(0.55 * p50 + 0.45 * p90, 6) as composite from m""")
def homogeneity_cosine(spark, sf_dir):
    found = homogeneity.whole_metrics(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")
    found = found.withColumns({"whole_score": stats.weighted(stats.WHOLE), "composite": stats.composite(F.col("whole_sem_p50"), F.col("whole_sem_p90"))})
    return found.select("label", "pairs", *[six(c).alias(c) for c in ("whole_sem_p50", "whole_sem_p90", "whole_highsim_ratio", "whole_score", "composite")])


#: Texts of a sample, rounds, and words of a text that stand for its images: the most frequent ones of four or more letters.
SAMPLED, ROUNDS, IMAGES = 6, 3, 12


@query()
def homogeneity_summary(spark, sf_dir):
    """Samples of each source, measures of their whole texts, sentences and images by round, then means over the rounds."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("category"))
    drawn = homogeneity.sample(docs.select("doc_id", "source"), ["source"], "doc_id", SAMPLED, rounds=ROUNDS)
    drawn = drawn.join(docs.drop("source"), "doc_id").join(labels, "doc_id", "left").repartition("source", "round")
    drawn = materialize(drawn.withColumn("embedding", encode_column(F.col("text"), hashed_ngrams())), "drawn")
    groups = ["source", "round"]
    counts = drawn.select(*groups, "doc_id", F.explode(words(F.col("text"))).alias("word")).filter(F.length("word") >= 4).groupBy(*groups, "doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    images = D.ranked_counts(counts, [*groups, "doc_id"], "word", IMAGES).groupBy(*groups, "doc_id").agg(F.sort_array(F.collect_list("word")).alias("images"))
    marked = drawn.join(images, [*groups, "doc_id"], "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))
    parts = drawn.select(*groups, "doc_id", F.posexplode(sentences(F.col("text"), LATIN_SENTENCE_MARKS)).alias("ordinal", "sentence"))
    parts = parts.repartition(*groups, "doc_id").withColumn("v", encode_column(F.col("sentence"), hashed_ngrams()))
    whole = homogeneity.whole_metrics(drawn, groups, "doc_id", "embedding", "text")
    joined = whole.join(homogeneity.imagery_metrics(marked, groups, "doc_id", "images", "category"), groups, "left").join(homogeneity.sentence_metrics(parts, groups, "doc_id", "sentence", "v"), groups, "left")
    found = homogeneity.average_rounds(homogeneity.composite_scores(joined), ["source"])
    return found.select("source", *[six(c).alias(c) for c in found.columns[1:]])


def _sentences(df, key, name):
    """Sentences of texts as texts of their own; their ids hold the text's id and the ordinal."""
    parts = df.select(F.col(key).alias("owner"), F.posexplode(sentences(F.col("text"), LATIN_SENTENCE_MARKS)).alias("ordinal", "text"))
    return parts.withColumn(name, F.shiftleft(F.col("owner").cast("long"), 20).bitwiseOR(F.col("ordinal").cast("long")))


@query()
def provenance_profile(spark, sf_dir):
    """Where each passage's sentences and the passage may come from, by meaning and by wording."""
    asked, corpus = _texts(spark, sf_dir)
    asked_vectors, corpus_vectors = (materialize(_vectors(df, key), name) for df, key, name in ((asked, "query_id", "passage-vectors"), (corpus, "corpus_id", "document-vectors")))
    semantic, merged = _candidates(asked, corpus, asked_vectors, corpus_vectors)
    whole_sem = semantic.filter("rank = 1").select(F.col("query_id").alias("item_id"), F.col("cosine").alias("whole_sem_score"), F.col("corpus_id").alias("whole_sem_source"))
    whole_lex = candidates.rerank(merged, asked, corpus, 1).select(F.col("query_id").alias("item_id"), F.col("score").alias("whole_lex_score"), F.col("corpus_id").alias("whole_lex_source"))
    some = corpus_vectors.filter("corpus_id % 50 = 0").select(F.col("corpus_id").alias("query_id"), "v")  # a stated set of documents against all
    usual = knn.top_k(some, corpus_vectors.select("corpus_id", "v"), 1, skip_same=True).select(F.lit("all").alias("scope"), F.col("cosine").alias("value"))
    ranked = scores.percentile_rank(whole_sem.select(F.lit("all").alias("scope"), "item_id", F.col("whole_sem_score").alias("value")), usual, ["scope"], "item_id", "value")
    parts, own = materialize(_sentences(asked.withColumnRenamed("query_id", "item_id"), "item_id", "query_id"), "passage-sentences"), materialize(_sentences(corpus, "corpus_id", "corpus_id"), "document-sentences")
    near, mixed = _candidates(parts.select("query_id", "text"), own.select("corpus_id", "text"), materialize(_vectors(parts, "query_id"), "sentence-vectors"))
    worded = candidates.rerank(mixed, parts.select("query_id", "text"), own.select("corpus_id", "text"), 1)
    owner = F.shiftright("corpus_id", 20)
    sem = near.filter("rank = 1").select("query_id", owner.alias("sem_source"), F.col("cosine").alias("sem_score"))
    lex = worded.select("query_id", owner.alias("lex_source"), F.col("score").alias("lex_score"))
    found = provenance.profile(parts.select("query_id", F.col("owner").alias("item_id"), "ordinal").join(sem, "query_id", "left").join(lex, "query_id", "left"), "item_id", "ordinal")
    full = found.join(whole_sem, "item_id", "left").join(whole_lex, "item_id", "left").join(ranked.select("item_id", F.col("percentile_rank").alias("whole_sem_percentile")), "item_id", "left")
    known = documents(spark, sf_dir).select(F.col("doc_id").alias("source_id"), F.col("source").alias("author"), F.col("lang").alias("title"))
    for source in ("whole_sem_source", "whole_lex_source", "sem_dominant_source", "lex_dominant_source"):
        full = provenance.attribute(full, known, source, ["title", "author"])
    rounded = {f.name: six(f.name) for f in full.schema.fields if f.dataType.typeName() == "double"}
    order = [F.desc(F.coalesce(c, F.lit(0.0))) for c in ("whole_sem_score", "sem_dominant_coverage", "whole_lex_score")]
    return full.withColumns(rounded).orderBy(*order, "item_id")


@query(f"""
with v as (select label, round(round(cosine, 9), 4) as v from ({_PAIRS})), s as (select label, count(*) as n, stddev_samp(v) * pow(count(*), -0.2) as h from v group by label having count(*) > 10)
select label, round(i / 99.0::double, 6) as x, round(avg(exp(-0.5 * pow((i / 99.0::double - v) / h, 2)) / (h * sqrt(2 * pi()))), 4) as density from v join s using (label), range(100) t(i) group by label, i""")
def density_by_group(spark, sf_dir):
    found = pairs.density(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")
    return found.select("label", six("x").alias("x"), F.round("density", 4).alias("density"))
