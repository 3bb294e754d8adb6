"""Queries over scores, issues and conditions; events stand in for scored texts, TPC-H tables for wide summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantorium.functions import stats
from cantorium.operators import descriptive as D
from cantorium.operators import provenance, scores
from cantorium.operators.quantiles import floor_percentiles, percentiles
from cantorium.plans.common import query, six
from cantorium.session import table


def _events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "ts", "user_id", "event_type", "value", (F.col("user_id") % 7).alias("db"), F.least("value", F.lit(100.0)).alias("score"))


@query("""
with b as (select user_id % 7 as db, event_type, least(value, 100) as s from events)
select db, event_type, count(*) as total, round(avg(s), 6) as avg_score, round(quantile_cont(s, 0.25), 6) as p25_score, round(quantile_cont(s, 0.5), 6) as p50_score,
  round(quantile_cont(s, 0.75), 6) as p75_score, round(avg((s >= 99.999)::int), 6) as perfect_ratio, round(avg((s >= 80 and s < 99.999)::int), 6) as high_ratio,
  round(avg((s >= 60 and s < 80)::int), 6) as mid_ratio, round(avg((s > 0 and s < 60)::int), 6) as low_ratio, round(avg((s = 0)::int), 6) as zero_ratio,
  round(avg((event_type is null)::int), 6) as issue_free_ratio
from b group by grouping sets ((db, event_type), (db), (event_type), ())""")
def score_rollup_grouping_sets(spark, sf_dir):
    events = _events(spark, sf_dir)
    found = scores.roll_up(events, F.col("score"), F.col("event_type"), [["db", "event_type"], ["db"], ["event_type"], []])
    return found.select("db", "event_type", "total", *[six(c).alias(c) for c in found.columns[3:]])


@query("""
with b as (select user_id % 7 as db, user_id, event_type, least(value, 100) as s from events)
select db, user_id, count(*) as total, round(avg(s), 6) as avg_score, round(quantile_cont(s, 0.5), 6) as p50_score,
  round(avg((event_type = 'error')::int), 6) as error_ratio, round(avg((event_type = 'click')::int), 6) as click_ratio
from b group by grouping sets ((db, user_id), (db)) having count(*) >= 8""")
def score_rollup_with_minimum(spark, sf_dir):
    """Rates by kind of issue, for groups of eight or more."""
    found = scores.roll_up(_events(spark, sf_dir), F.col("score"), F.col("event_type"), [["db", "user_id"], ["db"]], kinds=("error", "click"), least=8)
    return found.select("db", "user_id", "total", *[six(c).alias(c) for c in ("avg_score", "p50_score", "error_ratio", "click_ratio")])


@query("""
with k as (select distinct event_type as issue from events union select 'never_seen'),
c as (select user_id % 7 as db, event_type as issue, count(*) as issues, count(distinct user_id) as rows_with_issue from events group by all)
select db, issue, coalesce(rows_with_issue, 0) as rows_with_issue, coalesce(issues, 0) as issues
from (select distinct user_id % 7 as db from events) cross join k left join c using (db, issue)""")
def issue_unpivot_zero_fill(spark, sf_dir):
    events = _events(spark, sf_dir).withColumnRenamed("event_type", "issue")
    kinds = events.select("issue").distinct().unionByName(spark.createDataFrame([("never_seen",)], "issue string"))
    return scores.issue_breakdown(events, ["db"], "user_id", "issue", kinds)


@query("""
with b as (select user_id % 7 as db, case when least(value, 100) >= 99.999 then '100' when value >= 80 then '80_99' when value >= 60 then '60_79' when value > 0 then '1_59' else '0' end as bucket from events)
select d.db, k.bucket, count(b.bucket) as n from (select distinct db from b) d cross join (values ('100'), ('80_99'), ('60_79'), ('1_59'), ('0')) k(bucket)
left join b on b.db = d.db and b.bucket = k.bucket group by all""")
def score_buckets(spark, sf_dir):
    return scores.score_histogram(_events(spark, sf_dir), ["db"], F.col("score"))


@query("""
select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90,
  round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(max(value), 6) as max from events group by event_type""")
def percentile_linear(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cuts = percentiles(events, ["event_type"], "value", {f"p{p}": p for p in (50, 90, 95, 99)})
    sums = events.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return sums.join(cuts, "event_type").select("event_type", "n", *[six(c).alias(c) for c in ("mean", "p50", "p90", "p95", "p99", "max")])


@query("""
select l_returnflag, l_linestatus, list_sort(list(l_quantity))[(0.25 * (count(*) - 1))::double::bigint + 1 - (case when (0.25 * (count(*) - 1))::bigint > floor(0.25 * (count(*) - 1)) then 1 else 0 end)] as p25,
  list_sort(list(l_quantity))[floor(0.9 * (count(*) - 1))::bigint + 1] as p90 from lineitem group by all""")
def percentile_floor(spark, sf_dir):
    return floor_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", {"p25": 25, "p90": 90})


@query("""
select l_shipmode as mode, sum(l_quantity)::double as weight, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as l_discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) as l_tax
from (select *, l_returnflag || l_linestatus as l_shipmode from lineitem) group by all""")
def weighted_mean_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("mode", F.concat("l_returnflag", "l_linestatus"))
    return scores.weighted_means(lines, ["mode"], "l_quantity", ["l_discount", "l_tax"]).withColumns({"l_discount": six("l_discount"), "l_tax": six("l_tax")})


@query("""
with s as (select o_orderstatus as c, o_orderpriority as k, avg(o_totalprice) as v from orders group by all)
select a.c as "from", b.c as "to", a.k as o_orderpriority, round(b.v - a.v, 4) as price_delta from s a join s b using (k) where (a.c, b.c) in (('F', 'O'), ('F', 'P'), ('O', 'P'))""")
def condition_delta_selfjoin(spark, sf_dir):
    summary = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("price"))
    specs = spark.createDataFrame([("F", "O"), ("F", "P"), ("O", "P")], "from string, to string")
    return scores.condition_deltas(summary, specs, "o_orderstatus", ["o_orderpriority"], ["price"]).withColumn("price_delta", F.round("price_delta", 4))


_SUMMARY_SQL = "select user_id % 7 as db, event_type as model, round(avg(value), 6) as score, count(*)::double as volume from events group by all"


def _summary(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("db", F.col("event_type").alias("model")).agg(six(F.avg("value")).alias("score"), F.count(F.lit(1)).cast("double").alias("volume"))


@query(f"""
with s as ({_SUMMARY_SQL})
select *, row_number() over (partition by db order by score desc, model)::int as score_rank, round(score - avg(score) over (partition by db), 5) as score_deviation,
  row_number() over (partition by db order by volume desc, model)::int as volume_rank, round(volume - avg(volume) over (partition by db), 5) as volume_deviation,
  first(model) over (partition by db order by score desc, model) as top_name from s""")
def rank_and_deviation(spark, sf_dir):
    found = scores.ranks_and_deviations(_summary(spark, sf_dir), "db", "model", ["score", "volume"])
    return found.withColumns({c: F.round(c, 5) for c in ("score_deviation", "volume_deviation")})


@query(f"""
with s as ({_SUMMARY_SQL})
select model, max(struct_pack(v := score, c := db)).c as best, min(struct_pack(v := score, c := db)).c as worst, max(score) as best_value, min(score) as worst_value,
  round(avg(score), 5) as average, string_agg(db::varchar, '|' order by db::varchar) as conditions from s group by model""")
def best_worst_condition(spark, sf_dir):
    return scores.best_and_worst(_summary(spark, sf_dir), "model", "db", "score").withColumn("average", F.round("average", 5))


@query("""
with a as (select user_id % 7 as db, avg(value) - 245 as w, quantile_cont(value, 0.5) - 245 as s, quantile_cont(value, 0.9) - 441 as i from events group by all),
v as (select *, [struct_pack(v := w, n := 'whole'), struct_pack(v := s, n := 'sentence'), struct_pack(v := i, n := 'imagery')] as by_value,
  [struct_pack(v := abs(w), n := 'whole'), struct_pack(v := abs(s), n := 'sentence'), struct_pack(v := abs(i), n := 'imagery')] as by_size from a)
select db, list_sort(by_value)[-1].n as axis, list_sort(by_size)[-1].n as axis_by_size from v""")
def dominant_axis(spark, sf_dir):
    v = F.col("value")
    found = _events(spark, sf_dir).groupBy("db").agg((F.avg(v) - 245).alias("w"), (F.percentile(v, F.lit(0.5)) - 245).alias("s"), (F.percentile(v, F.lit(0.9)) - 441).alias("i"))
    axes = F.col("w"), F.col("s"), F.col("i")
    return found.select("db", stats.dominant_axis(*axes).alias("axis"), stats.dominant_axis(*axes, by_size=True).alias("axis_by_size"))


@query("""
with d as (select user_id % 7 as db, event_type, avg(value) - 245 as w, quantile_cont(value, 0.5) - 245 as s, quantile_cont(value, 0.9) - 441 as i from events group by all)
select db, count(*) as n, round(avg(w), 5) as mean_w, round(avg(s), 5) as mean_s, round(avg(i), 5) as mean_i, round(max_by(w, abs(w)), 5) as peak from d group by db""")
def contrast_summary(spark, sf_dir):
    v = F.col("value")
    deltas = _events(spark, sf_dir).groupBy("db", "event_type").agg((F.avg(v) - 245).alias("w"), (F.percentile(v, F.lit(0.5)) - 245).alias("s"), (F.percentile(v, F.lit(0.9)) - 441).alias("i"))
    found = scores.contrast_summary(deltas, ["db"], ("w", "s", "i"))
    return found.select("db", "n", *[F.round(c, 5).alias(c) for c in ("mean_w", "mean_s", "mean_i", "peak")])


@query("""
with s as (select source, lang, count(*) as n from documents where doc_id in (select doc_id from labels where quality = 1) group by all),
o as (select source, lang, count(*) as n from documents group by all)
select source, lang, coalesce(s.n, o.n) as n, case when s.n is null then 'observe' else 'strict' end as provenance from s full join o using (source, lang)""")
def prefer_left_else_right(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    count = lambda df: df.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    strict = count(docs.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi"))
    return scores.prefer(strict, count(docs), ["source", "lang"], ["n"])


@query("""
with p as (select user_id, event_id, event_type as v, case when lag(event_type) over w = event_type then 0 else 1 end as change from events window w as (partition by user_id order by event_id)),
i as (select user_id, v, sum(change) over (partition by user_id order by event_id) as island from p)
select user_id, max(n) as longest_run from (select user_id, island, count(*) as n from i group by all) group by user_id""")
def max_consecutive_run(spark, sf_dir):
    return scores.longest_run(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("""
select v.event_type, v.event_id, v.value, round((select count(*) filter (b.value <= v.value) / count(*) from events b where b.event_type = v.event_type and b.user_id % 7 <> 0), 6) as percentile_rank
from events v where v.user_id % 7 = 0""")
def percentile_rank_vs_baseline(spark, sf_dir):
    events = _events(spark, sf_dir)
    values, base = events.filter("db = 0").select("event_type", "event_id", "value"), events.filter("db <> 0").select("event_type", "value")
    return scores.percentile_rank(values, base, ["event_type"], "event_id", "value").withColumn("percentile_rank", six("percentile_rank"))


@query("""
select coalesce(event_type, '__overall__') as event_type, coalesce(bucket, '__overall__') as bucket, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50,
  round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(max(value), 6) as max
from (select event_type, 'b' || (user_id % 3) as bucket, value from events) group by grouping sets ((event_type, bucket), (bucket), ())""")
def baseline_distributions(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("bucket", F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")))
    found = provenance.baseline(events, "event_type", "bucket", "value")
    return found.select("event_type", "bucket", "n", *[six(c).alias(c) for c in found.columns[3:]])


@query("""
with c as (select event_type, props as message, count(*) as n from events group by all), r as (select *, row_number() over (partition by event_type order by n desc, message)::int as rank from c)
select event_type, message, n, rank, 'other' as kind from r where rank <= 15""")
def common_error_messages(spark, sf_dir):
    return scores.common_messages(table(spark, sf_dir, "events").withColumnRenamed("props", "message"), ["event_type"], "message")


@query("""
with j as (select event_type, json_extract_string(props, '$.k')::bigint as k from events)
select event_type, count(k) as parsed, sum(k)::bigint as total, count(distinct k) as distinct_k from j group by event_type""")
def json_props_parse(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return parsed.groupBy("event_type").agg(F.count("k").alias("parsed"), F.sum("k").alias("total"), F.countDistinct("k").alias("distinct_k"))


@query("""
with s as (select user_id % 7 as db, event_type, avg(value) as v from events group by all)
select db, """ + ", ".join(f"""coalesce(round(max(v) filter (event_type = '{e}'), 3), 0) as "{e}\"""" for e in ("click", "view", "purchase")) + " from s group by db")
def model_tune_matrix(spark, sf_dir):
    means = _events(spark, sf_dir).groupBy("db", "event_type").agg(F.avg("value").alias("v"))
    return scores.matrix(means, "db", "event_type", ["click", "view", "purchase"], "v")


@query("""
with c as (select user_id % 7 as db, event_type, count(*) as n from events group by all), p as (select *, n / sum(n) over (partition by db) as p from c)
select db, sum(n)::bigint as total, round(-sum(p * log2(p)), 6) as entropy, round(sum(p * p), 6) as hhi from p group by db""")
def event_entropy(spark, sf_dir):
    counts = D.value_counts(_events(spark, sf_dir), ["db"], "event_type")
    found = D.concentration(counts, ["db"], "event_type", 1)
    return found.select("db", "total", six("entropy").alias("entropy"), six("hhi").alias("hhi"))


@query("""
select event_type, round(quantile_cont(value, 0.05), 6) as p5, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50,
  round(quantile_cont(value, 0.75), 6) as p75, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type""")
def box_plot(spark, sf_dir):
    from cantorium.operators.pairs import box

    found = box(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", *[six(c).alias(c) for c in found.columns[1:]])
