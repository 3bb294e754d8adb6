"""Descriptive queries over documents, their sources and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantorium.functions import stats
from cantorium.operators import descriptive as D
from cantorium.operators import tables
from cantorium.plans.common import WORDS_SQL, documents, query, six, words
from cantorium.session import materialize, table

_EXPLODED = f"select source, lang, doc_id, unnest({WORDS_SQL}) as token from documents"


@query(f"""
with e as ({_EXPLODED}),
c as (select source, token, count(*) as n, count(distinct doc_id) as docs from e group by all),
s as (select source, count(*) as group_docs from documents group by source),
r as (select *, n / sum(n) over (partition by source) as share, row_number() over (partition by source order by n desc, token) as rank from c)
select source, token, n, docs, round(share, 6) as share, round(docs / group_docs, 6) as coverage, rank::int as rank
from r join s using (source) where rank <= 20""")
def token_top_by_group(spark, sf_dir):
    docs = documents(spark, sf_dir)
    coverage = materialize(D.token_coverage(docs, ["source"], words(F.col("text"))), "token-coverage")  # totals and ranks read it
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("group_docs"))
    return D.top_tokens(coverage, sizes, ["source"], 20).withColumns({"share": six("share"), "coverage": six("coverage")})


@query("""
with c as (select lang, source, count(*) as n from documents group by all)
select lang, source, n, round(n / sum(n) over (partition by lang), 6) as share, row_number() over (partition by lang order by n desc, source)::int as rank from c""")
def value_counts_share_rank(spark, sf_dir):
    return D.value_counts(documents(spark, sf_dir), ["lang"], "source").withColumn("share", six("share"))


@query("""
with c as (select source, lang, count(*) as n from documents group by all),
p as (select *, n / sum(n) over (partition by source) as p from c)
select source, sum(n)::bigint as total, count(*) as distinct_values, round(-sum(p * log2(p)), 6) + 0.0 as entropy,
  round(case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) else 0 end, 6) as normalized_entropy, round(sum(p * p), 6) as hhi
from p group by source""")
def group_entropy_hhi(spark, sf_dir):
    counts = D.value_counts(documents(spark, sf_dir), ["source"], "lang")
    found = D.concentration(counts, ["source"], "lang", 1).drop("topk_share")
    return found.withColumns({c: F.abs(six(c)) for c in ("entropy", "normalized_entropy", "hhi")})


@query(f"""
with c as (select lang, token, count(*) as n from ({_EXPLODED}) group by all),
r as (select *, row_number() over (partition by lang order by n desc, token) as r from c)
select lang, sum(n)::bigint as total, count(*) as distinct_values, round(sum(case when r <= 10 then n else 0 end) / sum(n), 6) as topk_share from r group by lang""")
def topk_concentration(spark, sf_dir):
    counts = materialize(D.explode_tokens(documents(spark, sf_dir), ["lang"], "doc_id", words(F.col("text"))).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    return D.concentration(counts, ["lang"], "token", 10).select("lang", "total", "distinct_values", six("topk_share").alias("topk_share"))


_CATEGORY_SQL = "select d.doc_id, d.source, 'q' || l.quality || 't' || l.toxic as category from documents d left join labels l using (doc_id)"


def _categories(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("category"))
    return documents(spark, sf_dir).join(labels, "doc_id", "left")


@query(f"""
with j as ({_CATEGORY_SQL}),
c as (select source, category, count(*) as n from j where category is not null group by all),
r as (select *, row_number() over (partition by source order by n desc, category) as r, n / sum(n) over (partition by source) as p from c),
t as (select source, string_agg(category || ':' || n, '|' order by r) filter (r <= 3) as top3, max(category) filter (r = 1) as top1,
  round(abs(-sum(p * log2(p))), 6) as entropy, round(sum(p * p), 6) as hhi from r group by source)
select source, count(*) as docs, count(category) as categorized, round(count(category) / count(*), 6) as coverage, top1, top3, entropy, hhi
from j left join t using (source) group by source, top1, top3, entropy, hhi""")
def category_summary_topn_string(spark, sf_dir):
    joined = _categories(spark, sf_dir)
    counts = D.value_counts(joined.filter(F.col("category").isNotNull()), ["source"], "category")
    sizes = joined.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count("category").alias("categorized"))
    spread = D.concentration(counts, ["source"], "category", 3).select("source", F.abs(six("entropy")).alias("entropy"), six("hhi").alias("hhi"))
    first = counts.filter("rank = 1").select("source", F.col("category").alias("top1"))
    found = sizes.join(first, "source", "left").join(D.top_string(counts, ["source"], "category", 3, "top3"), "source", "left").join(spread, "source", "left")
    return found.select("source", "docs", "categorized", six(F.col("categorized") / F.col("docs")).alias("coverage"), "top1", "top3", "entropy", "hhi")


@query(f"""
with e as (select lang as g, token, doc_id from ({_EXPLODED})),
gc as (select g, token, count(*) as n, count(distinct doc_id) as docs from e group by all),
sc as (select token, count(distinct doc_id) as scope_hits from e group by token),
gs as (select lang as g, count(*) as group_docs from documents group by all),
j as (select g, token, n, docs, docs / group_docs as gcov, scope_hits / (select count(*) from documents) as scov from gc join sc using (token) join gs using (g)),
r as (select *, gcov / scov as lift, row_number() over (partition by g order by round(gcov / scov, 9) desc, docs desc, n desc, token) as rank from j)
select g as lang, token, n, docs, round(gcov, 6) as group_coverage, round(scov, 6) as scope_coverage, round(lift, 6) as lift, rank::int as rank from r where rank <= 20""")
def lift_signature(spark, sf_dir):
    docs = documents(spark, sf_dir)
    group = materialize(D.token_coverage(docs, ["lang"], words(F.col("text"))), "token-coverage")
    scope = D.widened(group, [])
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("group_docs"))
    found = D.lift(group, scope, sizes, docs.agg(F.count(F.lit(1)).alias("scope_docs")), ["lang"], 20)
    return found.withColumns({c: six(c) for c in ("group_coverage", "scope_coverage", "lift")})


@query(f"""
with c as (select source, token, count(*) as n from ({_EXPLODED}) group by all),
w as (select source, token, row_number() over (partition by source order by n desc, token) <= 20 as top from c),
s as (select source, count(*) as size, count(*) filter (top) as top_size from w group by source),
i as (select a.source as a, b.source as b, count(*) as common, count(*) filter (a.top and b.top) as top_common from w a join w b on a.token = b.token and a.source < b.source group by all)
select x.source as a, y.source as b, coalesce(common, 0) as common, (x.size + y.size - coalesce(common, 0))::bigint as union_size,
  round(coalesce(common, 0) / (x.size + y.size - coalesce(common, 0)), 6) as jaccard, coalesce(top_common, 0) as top_common,
  round(coalesce(top_common, 0) / (x.top_size + y.top_size - coalesce(top_common, 0)), 6) as top_jaccard
from s x join s y on x.source < y.source left join i on i.a = x.source and i.b = y.source""")
def vocab_overlap_between_groups(spark, sf_dir):
    coverage = materialize(D.token_coverage(documents(spark, sf_dir), ["source"], words(F.col("text"))), "token-coverage")
    found = D.vocabulary_overlap(coverage, "source", 20)
    return found.withColumns({"jaccard": six("jaccard"), "top_jaccard": six("top_jaccard")})


@query("""
with s as (select doc_id, source, unnest(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[,.!?;\\n]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) as t from documents),
b as (select source, case when length(t) <= 5 then '<=5' when length(t) <= 8 then '6-8' when length(t) <= 11 then '9-11' when length(t) <= 14 then '12-14' else '15+' end as bucket, doc_id from s)
select source, bucket, count(*) as sentences, count(distinct doc_id) as docs from b group by all""")
def sentence_explode_buckets(spark, sf_dir):
    from cantorium.functions.text import LATIN_SENTENCE_MARKS, sentences

    parts = documents(spark, sf_dir).select("doc_id", "source", F.posexplode(sentences(F.col("text"), LATIN_SENTENCE_MARKS)).alias("ordinal", "sentence"))
    bucketed = parts.select("source", "doc_id", stats.length_bucket(F.col("sentence")).alias("bucket"))
    return bucketed.groupBy("source", "bucket", "doc_id").agg(F.count(F.lit(1)).alias("c")).groupBy("source", "bucket").agg(F.sum("c").alias("sentences"), F.count(F.lit(1)).alias("docs"))


@query("""
with h as (select unnest(string_split(coalesce(text, ''), chr(10))) as line from documents where doc_id % 2 = 0),
r as (select unnest(string_split(coalesce(text, ''), chr(10))) as line from documents where doc_id % 2 = 1),
a as (select line, count(*) as n from h group by line), b as (select line, count(*) as m from r group by line)
select a.line, n - coalesce(m, 0) as missing from a left join b using (line) where n > coalesce(m, 0)""")
def multiset_diff(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    even, odd = lines.filter("doc_id % 2 = 0").select("line"), lines.filter("doc_id % 2 = 1").select("line")
    return tables.multiset_difference(even, odd)


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def anti_join(spark, sf_dir):
    return tables.without(documents(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("select d.doc_id, case when l.doc_id is not null then 'q' || l.quality || 't' || l.toxic else d.source end as source from documents d left join labels l using (doc_id)")
def update_by_key(spark, sf_dir):
    changes = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("source"))
    return tables.update_by_key(documents(spark, sf_dir).select("doc_id", "source"), changes, "doc_id", ["source"])


@query("""
with o as (select *, md5(concat_ws('|', '42', source, r::varchar, doc_id::varchar)) as k from documents, range(3) t(r)),
p as (select source, r::int as round, doc_id, row_number() over (partition by source, r order by k, doc_id) as place from o)
select source, round, doc_id from p where place <= 5""")
def md5_sample_per_group(spark, sf_dir):
    from cantorium.operators.homogeneity import sample

    return sample(documents(spark, sf_dir).select("source", "doc_id"), ["source"], "doc_id", 5, rounds=3).select("source", "round", "doc_id")


@query("""
with c as (select source, lang, count(*) as n from documents group by all), a as (select *, sum(n) over (partition by source) as everything from c)
select lang, least(min(n), 20)::bigint as target from a where everything >= 30 and n >= 8 group by lang""")
def sampling_targets(spark, sf_dir):
    from cantorium.operators.homogeneity import target_sizes

    return target_sizes(documents(spark, sf_dir), "source", "lang").withColumn("target", F.col("target").cast("long"))


@query(f"""
with j as ({_CATEGORY_SQL}),
c as (select source, category, doc_id from j where category is not null)
select category, string_agg(source || ':' || n, '|' order by source) as by_source, sum(n)::bigint as docs from (select category, source, count(*) as n from c group by all) group by category""")
def category_by_source_string(spark, sf_dir):
    counts = _categories(spark, sf_dir).filter(F.col("category").isNotNull()).groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("category").agg(F.sort_array(F.collect_list(F.struct(F.col("source").alias("name"), "n"))).alias("items"), F.sum("n").alias("docs"))
    from cantorium.functions.text import ranked_string

    return listed.select("category", ranked_string(F.col("items")).alias("by_source"), "docs")
