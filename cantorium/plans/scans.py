"""Scans of poems, task configurations, lexicon text, files and streams, and joins with baselines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cantorium.functions import stats, text
from cantorium.operators import homogeneity, tables
from cantorium.plans.common import query, six
from cantorium.plans.literals import _values
from cantorium.plans.scores import _events
from cantorium.session import shared_dir, table
from cantorium.sources import files, poems
from cantorium.streaming import ingest

GENERATED = (
    ("b1", 1, "菩萨蛮", "t1", "明月几时有", '["白玉兰"," 明月，",""]', " 秋 ", "deepseek-v3.2", 80.0, '[" a ", null, ""]'), ("b1", 2, "菩萨蛮", "t2", "   ", "[]", "春", "x", 90.0, None),
    ("b1", 3, "如梦令", "t3", "春风又绿", '{"a":1}', None, "", None, "bad"), ("b2", 1, "如梦令", "t4", "细雨", "bad", "", "qwen3.6-plus", 59.9, "[]"),
    ("b2", 2, "如梦令", None, "孤舟", None, "夏", "unknown-model", 60.0, '["b","c"]'), ("b3", 9, "如梦令", None, "无元数据", None, "夏", "m", 99.0, None), ("b2", 3, "如梦令", "t", None, None, "冬", None, 100.0, None),
)
METADATA = (("b1", "规定词牌"), ("b2", "自由"))
_COLUMNS = "db, id, cipai, title, content, imagery, category, model_name, rhythm_score, rhythm_errors"


def _generated(spark):
    kinds = "db string, id long, cipai string, title string, content string, imagery string, category string, model_name string, rhythm_score double, rhythm_errors string"
    return spark.createDataFrame(list(GENERATED), kinds)


def _json_items(column: str) -> str:
    return f"case when json_valid({column}) and json_type({column}) = 'ARRAY' then list_filter(json_extract_string({column}, '$[*]'), lambda x: x is not null) else [] end"


@query(f"""
with g({_COLUMNS}) as (values {_values(GENERATED)}), m(db, label) as (values {_values(METADATA)}),
k(raw, name) as (values {_values(poems.MODEL_NAMES.items())}),
t as (select *, list_transform({_json_items("imagery")}, lambda x: regexp_replace(x, '[，。！？；、\\s　]', '', 'g')) as tokens,
  list_filter(list_transform({_json_items("rhythm_errors")}, lambda x: trim(x)), lambda x: x <> '') as messages from g)
select db || ':' || id as uid, label, cipai, title, content, coalesce(k.name, nullif(model_name, ''), 'Unknown') as model, coalesce(rhythm_score, 0) as rhythm_score, trim(category) as category,
  array_to_string(list_filter(list_transform(tokens, lambda x: case when x in ('白玉兰', '玉兰花') then '玉兰' else x end), lambda x: x <> ''), '|') as imagery, array_to_string(messages, '|') as errors
from t join m using (db) left join k on raw = model_name where content is not null and trim(content) <> '' and (rhythm_score is null or rhythm_score >= 60)""")
def generated_poem_scan(spark, sf_dir):
    """Usable poems of all experiments with their metadata, names and lists made equal."""
    found = poems.generated(_generated(spark), 60, spark.createDataFrame(list(METADATA), "db string, label string"))
    return found.select("uid", "label", "cipai", "title", "content", "model", "rhythm_score", "category", F.array_join("imagery", "|").alias("imagery"), F.array_join("errors", "|").alias("errors"))


HUMAN = ((1, "苏轼", "水调歌头·明月几时有", "水调歌头", "明月几时有", 90.0), (2, None, None, "如梦令", "常记溪亭日暮", None), (3, "李白", "x", "菩萨蛮", " ", 1.0), (4, "柳永", "y", "雨霖铃", "寒蝉凄切", 2.0))


@query(f"""
with h(id, author, full_rhythmic, cipai, content, rhythm_score) as (values {_values(HUMAN)})
select id, coalesce(author, '') as author, coalesce(full_rhythmic, cipai) as full_rhythmic, cipai, content from h where trim(content) <> '' and cipai in ('水调歌头', '如梦令', '菩萨蛮')""")
def human_poem_scan(spark, sf_dir):
    """The human corpus of some tunes."""
    rows = spark.createDataFrame(list(HUMAN), poems.HUMAN)
    tunes = spark.createDataFrame([("水调歌头",), ("如梦令",), ("菩萨蛮",), ("菩萨蛮",)], "cipai string")
    return poems.human(rows, tunes).select("id", "author", "full_rhythmic", "cipai", "content")


@query(f"with g({_COLUMNS}) as (values {_values(GENERATED)}) select db, id, cipai from g where coalesce(imagery, '') = ''")
def pending_poem_scan(spark, sf_dir):
    """Poems that are not annotated yet."""
    return poems.pending(_generated(spark)).select("db", "id", "cipai")


@query("select distinct lang as cipai from documents where source < 'src3' union select unnest(['fr', 'xx', 'en'])")
def allowed_tune_union(spark, sf_dir):
    """Listed tunes and those of experiments without a list."""
    metadata = spark.createDataFrame([(["fr", "xx"],), (["en", "fr"],)], "allowed_cipais array<string>")
    return poems.allowed_tunes(metadata, table(spark, sf_dir, "documents").filter("source < 'src3'").select(F.col("lang").alias("cipai")))


SKETCHES = (("1224,13", 5, "双调六十六字", ""), ("12,3", 3, "", "又名x，一百零五字"), ("24|24*", 2, "", ""), ("1313", 9, "十字", "九字"), ("4.4$", 2, None, None))


@query(f"""
with s(sketch, expected, mode, brief) as (values {_values(SKETCHES)}), n(numeral, n) as (values ('六十六', 66), ('一百零五', 105), ('十', 10), ('九', 9)),
f as (select *, length(regexp_replace(sketch, '[,.\\\\`|*$]', '', 'g')) as was, replace(replace(sketch, '24', '4'), '13', '3') as fixed,
  coalesce(nullif(regexp_extract(mode, '([一二三四五六七八九十百零]+)字', 1), ''), nullif(regexp_extract(brief, '([一二三四五六七八九十百零]+)字', 1), '')) as named from s),
c as (select *, length(regexp_replace(fixed, '[,.\\\\`|*$]', '', 'g')) as now from f)
select sketch, was::int as slots, case when was <> expected and (now = expected or now = expected * 2) then fixed else sketch end as repaired, n::int as named_length from c left join n on numeral = named""")
def tune_pattern_text(spark, sf_dir):
    """Lengths that a tune's description names, slots of its pattern, and the repair of misread digits."""
    rows = spark.createDataFrame(list(SKETCHES), "sketch string, expected int, mode string, brief string")
    return rows.select("sketch", text.slot_count(F.col("sketch")).alias("slots"), text.repair_pattern(F.col("sketch"), F.col("expected")).alias("repaired"), text.expected_length(F.col("mode"), F.col("brief")).cast("int").alias("named_length"))


@query("select n_nationkey, replace(replace('写{cipai}于{theme}：{cipai}', '{cipai}', n_name), '{theme}', coalesce(nullif(n_regionkey::varchar, '0'), '')) as prompt from nation")
def prompt_filling(spark, sf_dir):
    """Templates with a tune of the pool (here of one) and a theme that may be missing."""
    rows = table(spark, sf_dir, "nation").withColumn("theme", F.nullif(F.col("n_regionkey").cast("string"), F.lit("0")))
    filled = text.fill_prompt(F.lit("写{cipai}于{theme}：{cipai}"), F.array("n_name"), F.col("theme"), F.col("n_nationkey").cast("string"))
    return rows.select("n_nationkey", filled.alias("prompt"))


CONFIG = '{"providers":{"p":{"api_key":"k","base_url":"u"},"q":{"api_key":"l"}},"tasks":[{"name":"a","provider":"p","total_requests":2},{"name":"b","provider":"q"},{"name":"c","provider":"none","total_requests":1}]}'


@query(f"""
with c(j) as (values ('{CONFIG}')), t as (select unnest(json_extract(j, '$.tasks[*]')) as t, j from c)
select t ->> 'name' as name, t ->> 'provider' as provider, (t ->> 'total_requests')::bigint as total_requests, json_extract_string(j, '$.providers.' || (t ->> 'provider') || '.base_url') as base_url,
  json_extract_string(j, '$.providers.' || (t ->> 'provider') || '.api_key') as api_key from t""")
def task_providers(spark, sf_dir):
    """Tasks with their provider's address, null where the provider is unknown."""
    found = files.task_rows(spark.createDataFrame([(CONFIG,)], "value string"))
    return found.select("name", "provider", "total_requests", "base_url", "api_key")


@query("""
with i as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as pos, turn from conversations),
r as (select conv_id, pos as at, case when conv_id % 3 = 0 then null when conv_id % 3 = 1 then pos + 1 else pos + 2 end as id, 'r' || pos as value from i)
select i.conv_id, i.pos, coalesce(n.value, p.value) as value from i left join r n on n.conv_id = i.conv_id and n.id = i.pos + 1 left join r p on p.conv_id = i.conv_id and p.at = i.pos""")
def batch_results(spark, sf_dir):
    """Results of a batch by their own number, else by position."""
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("int")
    items = table(spark, sf_dir, "conversations").select("conv_id", place.alias("pos"))
    number = F.when(F.col("conv_id") % 3 == 1, F.col("pos") + 1).when(F.col("conv_id") % 3 == 2, F.col("pos") + 2)
    results = items.select("conv_id", F.col("pos").alias("at"), number.alias("id"), F.concat(F.lit("r"), "pos").alias("value"))
    return tables.by_id_or_position(items, results, "conv_id")


_METRICS = "select user_id % 7 as db, event_type, avg(value) as score, count(*) as n from events group by all"


@query(f"""
with m as ({_METRICS}) select a.db, a.event_type, round(a.score, 6) as score, round(h.score, 6) as human_score, round(a.score - h.score, 6) as excess_score
from m a left join (select * from m where db = 0 and event_type <> 'view') h using (event_type) where a.db <> 0""")
def metrics_against_baseline(spark, sf_dir):
    """Metrics with the human baseline of the same key, null where there is none."""
    means = _events(spark, sf_dir).groupBy("db", "event_type").agg(F.avg("value").alias("score"))
    human = means.filter("db = 0 and event_type <> 'view'")
    found = homogeneity.against_baseline(means.filter("db <> 0"), human, ["event_type"], ["score"])
    return found.select("db", "event_type", *[six(c).alias(c) for c in ("score", "human_score", "excess_score")])


@query("""
with r as (select event_type, user_id % 3 as round, case when user_id % 3 < 2 or event_type <> 'view' then avg(value) end as score, stddev_samp(value) as spread from events group by event_type, user_id % 3)
select event_type, round(avg(score), 6) as score, round(avg(spread), 6) as spread from r group by event_type""")
def round_averages(spark, sf_dir):
    """Means over resampling rounds; rounds without a value are skipped."""
    by_round = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("round")).agg(F.avg("value").alias("score"), F.stddev_samp("value").alias("spread"))
    missing = (F.col("round") < 2) | (F.col("event_type") != "view")
    found = homogeneity.average_rounds(by_round.withColumn("score", F.when(missing, F.col("score"))), ["event_type"])
    return found.select("event_type", six("score").alias("score"), six("spread").alias("spread"))


@query("select event_type, round(avg((value / 100 - (user_id % 10) / 10.0::double > 0.3)::int), 6) as pseudo_ratio from events group by event_type")
def pseudo_original_share(spark, sf_dir):
    """How often one similarity is far above the other."""
    share = stats.pseudo_share(F.col("value") / 100, (F.col("user_id") % 10) / F.lit(10.0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(six(share).alias("pseudo_ratio"))


@query("""
with e as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k""")
def session_event_counts(spark, sf_dir):
    """2.11: sessions that end after a gap of half an hour."""
    found = ingest.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""
with w as (select time_bucket(interval '5 minutes', ts) - k * interval '5 minutes' as start, event_type, value from events, range(2) t(k))
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from w group by all""")
def sliding_event_counts(spark, sf_dir):
    """2.11: windows of ten minutes, a new one every five."""
    found = ingest.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "10 minutes", "5 minutes")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select doc_id, lang, source, text, round(n_chars / 7.0::double, 6) as share from documents where text <> ''")
def csv_round_trip(spark, sf_dir):
    """Texts with quotes, commas and line breaks written as CSV and read again."""
    docs = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "lang", "source", "text", (F.col("n_chars") / F.lit(7.0)).alias("share"))
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(docs, path)
    return files.read_csv(spark, path, "doc_id long, lang string, source string, text string, share double")


@query("select doc_id, quality, toxic from labels")
def incremental_ingest(spark, sf_dir):
    """S21, 2.11: a stream over the labels' files, appended to a table once for each id, in two runs of which the second finds nothing new."""
    place = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    source = f"{place}/arrived"
    labels = table(spark, sf_dir, "labels")
    labels.write.parquet(source)
    schema = labels.schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    for run in (1, 2):
        ingest.ingest(spark, source, kinds, f"{place}/table", f"{place}/checkpoint-{run}", "doc_id").awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/table").select("doc_id", "quality", "toxic")


@query("select n_nationkey, to_json(struct_pack(k := n_nationkey, v := n_name))::varchar as json, printf('%.4f', n_regionkey / 8.0::double) as fixed from nation")
def compact_json_and_decimals(spark, sf_dir):
    """F14, F18."""
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", text.compact_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))).alias("json"), text.fixed(F.col("n_regionkey") / F.lit(8.0)).alias("fixed"))


NUMBERS = ("1.5", "x", None, "", "-3", "1e3")


@query(f"with v(raw) as (values {_values([(n,) for n in NUMBERS])}) select raw, coalesce(try_cast(raw as double), 0) as number from v")
def numbers_or_default(spark, sf_dir):
    """F17."""
    return spark.createDataFrame([(n,) for n in NUMBERS], "raw string").select("raw", text.number(F.col("raw")).alias("number"))


@query(f"with m(family, texts) as (values {_values([(f, '|'.join(t)) for f, t in poems.MOCK.items()])}) select family, len(string_split(texts, '|')) as n, texts from m")
def mock_corpus(spark, sf_dir):
    """The literal corpus, by family."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member", "text"))), lambda x: x["text"]), "|")
    return poems.mock(spark).groupBy("family").agg(F.count(F.lit(1)).alias("n"), listed.alias("texts"))
