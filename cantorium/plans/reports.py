"""Report queries: token profiles of groups and categories, attribution, suspicion, status, sensitivity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cantorium.functions import stats
from cantorium.functions.encoder import encode_column, hashed_ngrams
from cantorium.functions.lexical import with_ratio
from cantorium.operators import descriptive as D
from cantorium.operators import knn, pairs, provenance, scores
from cantorium.operators.homogeneity import free_target_sizes
from cantorium.operators.quantiles import cumulative_share
from cantorium.plans.common import WORDS_SQL, documents, query, six, words
from cantorium.plans.scores import _events
from cantorium.session import materialize, table

_TOKENS = f"select doc_id, source, lang, unnest({WORDS_SQL}) as token from documents"


@query(f"""
with e as ({_TOKENS}), c as (select source, token, count(*) as n from e group by all),
r as (select *, row_number() over (partition by source order by n desc, token) as r, n / sum(n) over (partition by source) as p from c),
t as (select source, sum(n)::bigint as tokens, count(*) as distinct_tokens, round(-sum(p * log2(p)), 6) as entropy, round(sum(p * p), 6) as hhi,
  round(sum(case when r <= 10 then n else 0 end) / sum(n), 6) as top10_share, string_agg(token || ':' || n, '|' order by r) filter (r <= 5) as top5 from r group by source),
d as (select source, count(*) as docs from documents group by source), v as (select source, count(distinct doc_id) as covered from e group by source)
select source, docs, covered, round(covered / docs, 6) as coverage, tokens, distinct_tokens, round(tokens / covered, 6) as tokens_per_doc, entropy, hhi, top10_share, top5 from d join v using (source) join t using (source)""")
def token_summary_by_group(spark, sf_dir):
    """A24, A26."""
    docs = documents(spark, sf_dir).withColumn("tokens", words(F.col("text")))
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum((F.size("tokens") > 0).cast("long")).alias("covered"))
    counts = materialize(docs.select("source", F.explode("tokens").alias("token")).groupBy("source", "token").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    spread = D.concentration(counts, ["source"], "token", 10)
    joined = sizes.join(spread, "source").join(D.top_string(counts, ["source"], "token", 5, "top5"), "source")
    return joined.select(
        "source", "docs", "covered", six(F.col("covered") / F.col("docs")).alias("coverage"), F.col("total").alias("tokens"), F.col("distinct_values").alias("distinct_tokens"),
        six(F.col("total") / F.col("covered")).alias("tokens_per_doc"), six("entropy").alias("entropy"), six("hhi").alias("hhi"), six("topk_share").alias("top10_share"), "top5",
    )


_CATEGORY = f"select doc_id, lang, 'q' || quality || 't' || toxic as category, token from ({_TOKENS}) join labels using (doc_id)"


@query(f"""
with e as ({_CATEGORY}), c as (select lang, category, token, count(*) as n, count(distinct doc_id) as docs from e group by all),
s as (select lang, token, count(distinct doc_id) as hits from e group by all), gd as (select lang, category, count(distinct doc_id) as group_docs from e group by all), ld as (select lang, count(distinct doc_id) as scope_docs from e group by all),
j as (select *, docs / group_docs as gc, hits / scope_docs as sc from c join s using (lang, token) join gd using (lang, category) join ld using (lang)),
r as (select *, row_number() over (partition by lang, category order by n desc, token) as rank from j)
select lang, category, token, n, docs, round(gc, 6) as coverage, round(gc / sc, 6) as lift, rank::int as rank from r where rank <= 20""")
def token_top_by_category_lift(spark, sf_dir):
    """The scope of a category's lift is its language."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("category"))
    marked = documents(spark, sf_dir).join(labels, "doc_id").withColumn("tokens", words(F.col("text"))).filter(F.size("tokens") > 0)
    own = materialize(D.token_coverage(marked, ["lang", "category"], F.col("tokens")), "token-coverage")
    seen = marked.select("lang", "category", "doc_id")
    sizes = seen.groupBy("lang", "category").agg(F.count(F.lit(1)).alias("group_docs"))
    scope = D.widened(own, ["lang"]).select("lang", "token", F.col("docs").alias("hits"))
    scope_sizes = sizes.groupBy("lang").agg(F.sum("group_docs").alias("scope_docs"))
    top = D.top_tokens(own, sizes, ["lang", "category"], 20)
    joined = top.join(scope, ["lang", "token"]).join(scope_sizes, "lang")
    return joined.select("lang", "category", "token", "n", "docs", six("coverage").alias("coverage"), six(F.col("coverage") / (F.col("hits") / F.col("scope_docs"))).alias("lift"), "rank")


@query("""
with s as (select turn, conv_id, role, length(text) as n from conversations)
select conv_id, count(*) as pairs, round(avg(abs(a.n - b.n)), 6) as mean_gap, max(abs(a.n - b.n)) as max_gap from s a join s b using (conv_id) where a.turn < b.turn group by conv_id""")
def intra_group_pairs(spark, sf_dir):
    """Pairs of turns inside a conversation, and how far apart their lengths are."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    gap = F.abs(F.col("n_a") - F.col("n_b"))
    return pairs.within(turns, ["conv_id"], "turn", ["n"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("pairs"), six(F.avg(gap)).alias("mean_gap"), F.max(gap).alias("max_gap"))


_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
_AI_HUMAN = f"select a.vec_id as query_id, b.vec_id as corpus_id, a.label as la, b.label as lb, {_COS} as cosine from embeddings a join embeddings b on a.vec_id % 5 = 0 and b.vec_id % 5 <> 0"


def _sides(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"), F.col("label").alias("la"))
    return asked, vectors.filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("v"), F.col("label").alias("lb"))


@query(f"select la as label, query_id, corpus_id, round(cosine, 6) as cosine from ({_AI_HUMAN}) where la = lb and cosine >= 0.2")
def cross_corpus_pairs(spark, sf_dir):
    """Two corpora inside a group, above a threshold."""
    asked, corpus = _sides(spark, sf_dir)
    found = pairs.cosine_between(asked.withColumnRenamed("la", "label"), corpus.withColumnRenamed("lb", "label"), ["label"], "query_id", "corpus_id", "v", 0.2)
    return found.withColumn("cosine", six("cosine"))


@query()
def suspicion_report(spark, sf_dir):
    """The nearest row of the other corpus, with flags and a threat score from the sequence ratio of their documents; ids tie vectors to documents."""
    asked, corpus = _sides(spark, sf_dir)
    top = materialize(knn.top_k(asked, corpus, 1), "nearest").join(asked.select("query_id", "la"), "query_id").join(corpus.select("corpus_id", "lb"), "corpus_id")
    docs = documents(spark, sf_dir)
    a, b = (docs.select(F.col("doc_id").alias(key), F.col("text").alias(name)) for key, name in (("query_id", "text_a"), ("corpus_id", "text_b")))
    texts = top.join(a, "query_id", "left").join(b, "corpus_id", "left")
    lexical = materialize(with_ratio(texts, "query_id", "text_a", "text_b", "lexical"), "suspects")
    return lexical.select(
        "query_id", "corpus_id", six("cosine").alias("cosine"), six("lexical").alias("lexical"), (F.col("la") != F.col("lb")).alias("cross_label"),
        six(stats.threat(F.col("cosine"), F.col("lexical"))).alias("threat"), stats.suspicious(F.col("cosine"), F.col("lexical")).alias("suspicious"),
    )


@query()
def intra_text_similarity(spark, sf_dir):
    """Means and maxima of meaning and wording over the pairs of a conversation's turns, most alike first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").repartition("conv_id")
    turns = materialize(turns.withColumn("v", encode_column(F.col("text"), hashed_ngrams())), "turn-vectors")
    found = materialize(pairs.text_measures(turns, ["conv_id"], "turn", "v", "text"), "turn-measures")  # sorting reads them twice
    return found.select("conv_id", "pairs", *[six(f"{n}_{c}").alias(f"{n}_{c}") for c in ("sem", "lex") for n in ("avg", "max")]).orderBy(F.desc("avg_sem"), "conv_id")


_BASE = """
select coalesce(event_type, '__overall__') as g, coalesce(bucket, '__overall__') as b, count(*) as base_n, quantile_cont(value, 0.9) as base_p90
from (select event_type, 'b' || (user_id % 3) as bucket, value from events where user_id % 7 <> 0 and event_type <> 'error') group by grouping sets ((event_type, bucket), (bucket), ())"""


@query(f"""
with base as ({_BASE}), q as (select event_id, event_type, 'b' || (user_id % 4) as bucket, value from events where user_id % 7 = 0)
select event_id, event_type, bucket, coalesce(x.base_n, y.base_n, z.base_n) as n, round(coalesce(x.base_p90, y.base_p90, z.base_p90), 6) as p90 from q
left join base x on x.g = event_type and x.b = bucket and x.g <> '__overall__' left join base y on y.g = '__overall__' and y.b = bucket and y.b <> '__overall__'
cross join (select * from base where g = '__overall__' and b = '__overall__') z""")
def baseline_fallback(spark, sf_dir):
    """Unseen groups fall back to their bucket, unseen buckets to the whole."""
    events = _events(spark, sf_dir)
    base = provenance.baseline(events.filter("db <> 0 and event_type <> 'error'").withColumn("bucket", F.concat(F.lit("b"), F.col("user_id") % 3)), "event_type", "bucket", "value")
    asked = events.filter("db = 0").select("event_id", "event_type", F.concat(F.lit("b"), F.col("user_id") % 4).alias("bucket"))
    return provenance.with_fallback(asked, base, "event_type", "bucket", ["n", "p90"]).withColumn("p90", six("p90"))


@query("""
with p as (select event_type, user_id as source, value / 490.02 as score, percent from (select *, cume_dist() over (partition by event_type order by value) as percent from events)),
t as (select event_type, count(*) as n, round(avg((percent >= 0.95)::int), 6) as tail_95, round(avg((percent >= 0.99)::int), 6) as tail_99, round(avg((score >= 0.999999)::int), 6) as exact, round(avg(score), 6) as mean_score from p group by event_type),
c as (select event_type, source, count(*) as n from p group by all), r as (select *, row_number() over (partition by event_type order by n desc, source) as r from c),
l as (select event_type, '[' || string_agg('{"source":"' || source || '","n":' || n || '}', ',' order by r) || ']' as top_sources from r where r <= 5 group by event_type)
select * from t left join l using (event_type)""")
def source_report(spark, sf_dir):
    """Tail shares, exact matches and the top sources of each group."""
    events = table(spark, sf_dir, "events")
    ranked = cumulative_share(events, ["event_type"], "value").withColumnRenamed("share", "percent")
    rows = events.join(ranked, ["event_type", "value"]).select("event_type", F.col("user_id").alias("source"), (F.col("value") / 490.02).alias("score"), "percent")
    found = provenance.report(rows, "event_type", "percent", "source", "score")
    return found.select("event_type", "n", *[six(c).alias(c) for c in ("tail_95", "tail_99", "exact", "mean_score")], "top_sources")


@query("""
with g as (select source, count(*) as docs, count(distinct lang) as tunes, sum(case when n_chars >= 500 then 1 else 0 end)::bigint as used, case when source < 'src2' then 'single_cipai' when source < 'src5' then 'free' else 'fixed_pool' end as mode from documents group by source),
s as (select *, case when tunes = 0 then 'insufficient_usable_cipai' when mode = 'free' then 'exploratory' when mode = 'single_cipai' and docs >= 30 and tunes >= 1 then 'main'
  when mode = 'fixed_pool' and docs >= 30 and tunes >= 3 and used >= 24 then 'main' else 'low_sample' end as status from g)
select source, mode, docs, tunes, used, status, row_number() over (order by case status when 'main' then 0 when 'exploratory' then 1 when 'low_sample' then 2 else 3 end, docs desc, source)::int as place from s""")
def status_classification(spark, sf_dir):
    """A status by mode and counts, in an order with a rank map and mixed directions (a few rows a model)."""
    mode = F.when(F.col("source") < "src2", "single_cipai").when(F.col("source") < "src5", "free").otherwise("fixed_pool")
    used = F.sum(F.when(F.col("n_chars") >= 500, 1).otherwise(0))
    groups = documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("lang").alias("tunes"), used.alias("used")).withColumn("mode", mode)
    marked = groups.withColumn("status", stats.status(F.col("mode"), F.col("docs"), F.col("tunes"), F.col("used")))
    place = F.when(F.col("status") == "main", 0).when(F.col("status") == "exploratory", 1).when(F.col("status") == "low_sample", 2).otherwise(3)
    return marked.withColumn("place", F.row_number().over(Window.orderBy(place, F.desc("docs"), "source"))).orderBy("place")


@query("""
with d as (select case when user_id % 7 < 2 then 'theme' else 'strong' end as contrast, user_id % 7 as db, event_type, avg(value) - 245 as w, quantile_cont(value, 0.5) - 245 as s, quantile_cont(value, 0.9) - 441 as i from events group by all),
m as (select contrast, event_type, count(*) as n, avg(w) as w, avg(s) as s, avg(i) as i from d group by all)
select contrast, event_type, n, round(w, 5) as mean_w, round(s, 5) as mean_s, round(i, 5) as mean_i,
  list_sort([struct_pack(v := w, n := 'whole'), struct_pack(v := s, n := 'sentence'), struct_pack(v := i, n := 'imagery')])[-1].n as dominant,
  list_sort([struct_pack(v := abs(w), n := 'whole'), struct_pack(v := abs(s), n := 'sentence'), struct_pack(v := abs(i), n := 'imagery')])[-1].n as dominant_by_size from m""")
def constraint_sensitivity(spark, sf_dir):
    """Two contrast groups of deltas by model, with the axis that moves most."""
    v = F.col("value")
    deltas = _events(spark, sf_dir).groupBy("db", "event_type").agg((F.avg(v) - 245).alias("w"), (F.percentile(v, F.lit(0.5)) - 245).alias("s"), (F.percentile(v, F.lit(0.9)) - 441).alias("i"))
    contrast = F.when(F.col("db") < 2, "theme").otherwise("strong")
    found = scores.contrast_summary(deltas.withColumn("contrast", contrast), ["contrast", "event_type"], ("w", "s", "i"))
    return found.select("contrast", "event_type", "n", *[F.round(f"mean_{a}", 5).alias(f"mean_{a}") for a in "wsi"], "dominant", "dominant_by_size")


@query(f"""
with p as (select a.label, a.vec_id as src, b.vec_id as dst, {_COS} as w from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id),
k as (select 'label=' || label as scope, src, dst, w from p where w >= 0.3 union all select 'global', src, dst, w from p where w >= 0.3
  union all select 'label=' || label || ',bucket=' || (src % 3), src, dst, w from p where w >= 0.3 and src % 3 = dst % 3)
select scope, count(*) as edges, (select count(distinct n) from (select src as n from k x where x.scope = k.scope union select dst from k y where y.scope = k.scope)) as nodes, round(max(w), 6) as strongest from k group by scope""")
def scoped_graphs(spark, sf_dir):
    """One edge table over several scopes."""
    found = pairs.cosine_pairs(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 0.3)
    label = F.concat(F.lit("label="), F.col("label").cast("string"))
    bucket = F.when(F.col("vec_id_a") % 3 == F.col("vec_id_b") % 3, F.concat(label, F.lit(",bucket="), (F.col("vec_id_a") % 3).cast("string")))
    scopes = F.explode(F.array_compact(F.array(label, F.lit("global"), bucket)))
    rows = found.select(scopes.alias("scope"), F.col("vec_id_a").alias("src"), F.col("vec_id_b").alias("dst"), "cosine")
    nodes = rows.select("scope", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("nodes"))
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("edges"), six(F.max("cosine")).alias("strongest")).join(nodes, "scope").select("scope", "edges", "nodes", "strongest")


@query("""
with c as (select source, lang, count(*) as n from documents group by all)
select lang, count(*) as groups, sum(n)::bigint as docs from c where n >= 2 group by lang having count(*) >= 2""")
def minimum_group_sizes(spark, sf_dir):
    """Groups that are too small go before anything is averaged over them."""
    counts = documents(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return counts.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("docs")).filter("groups >= 2")


@query("select lang, least(count(*), 20)::bigint as target from documents group by lang having count(*) >= 8")
def free_sampling_targets(spark, sf_dir):
    """Sizes of the samples where texts choose their own tune."""
    return free_target_sizes(documents(spark, sf_dir), "lang").withColumn("target", F.col("target").cast("long"))
