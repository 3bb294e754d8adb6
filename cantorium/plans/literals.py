"""Queries over literal inputs: the prosody mini-lexicon, text scalars, answers of language models, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantorium.functions import stats, text
from cantorium.functions.lexical import extract_json_array
from cantorium.operators import prosody, tables
from cantorium.plans.common import query
from cantorium.sources.files import rhyme_rows

RHYMES = (("平声一东", "东风中"), ("平声二冬", "冬农"), ("平声三江", "江"), ("上声一董", "动"), ("去声一送", "送中"))
MERGED = (("第一部", "平", "东"), ("第一部", "平", "冬"))
SLOTS = (("测试令", 0, 0, 0, "平", False), ("测试令", 0, 0, 1, "仄", False), ("测试令", 0, 0, 2, "平", True), ("测试令慢", 1, 0, 0, "平", True), ("测试令慢", 1, 0, 1, "平", True))
POEMS = (
    (1, "测试令", "风动东"), (2, "测试令", "中中中"), (3, "测试令", "动风东"), (4, "测试令", "风动送"), (5, "测试令", "风动龘"), (6, "测试令", "风动"),
    (7, "测试令", "风"), (8, "无此调", "风动东"), (9, "测试令慢", "东冬"), (10, "测试令慢", "东江"), (11, "测试令", None), (12, "测试令", "风，动！东。"),
)


def lexicon(spark):
    keys = spark.createDataFrame([(i, *r) for i, r in enumerate(RHYMES)], "place int, key string, chars string")
    merged = spark.createDataFrame(list(MERGED), "label string, tone string, group string")
    slots = spark.createDataFrame(list(SLOTS), "pattern string, pattern_order int, variant int, pos int, tune string, is_rhyme boolean")
    return slots, prosody.readings_by_char(rhyme_rows(keys, text.rhyme_group), merged)


def _values(rows) -> str:
    cell = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else f"'{x}'"
    return ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)


def _prosody_sql(strict: bool) -> str:
    group = "regexp_replace(regexp_replace(k, '[（(].*?[）)]|韵', '', 'g'), '^[平上去入]声[一二三四五六七八九十百]*', '')"
    core = "regexp_replace({0}, '^(摊破|减字|偷声|促拍|添字)|(令|引|近|慢|犯)$', '', 'g')"
    broken = "p.points + case when hits and not exists (select 1 from readings r where r.ch = p.ch and (r.tone = '平') = (p.tune = '平') and (r.g = p.anchor or coalesce(r.label = p.anchor_label, false))) then 5 else 0 end"
    return f"""
with k(place, k, cs) as (values {_values([(i, *r) for i, r in enumerate(RHYMES)])}), m(label, tone, g) as (values {_values(MERGED)}),
readings as (select ch, r.tone, r.g, place, label from (select unnest(list_distinct(string_split(cs, ''))) as ch, substr(k, 1, 1) as tone, {group} as g, place from k) r left join m on m.tone = r.tone and m.g = r.g),
chars as (select ch, bool_or(tone = '平') as flat, bool_or(tone <> '平') as oblique from readings group by ch),
slots(pattern, pattern_order, variant, pos, tune, is_rhyme) as (values {_values(SLOTS)}), poems(poem_id, requested, content) as (values {_values(POEMS)}),
variants as (select pattern, pattern_order, variant, count(*) as n_slots from slots group by all),
routed as (select requested, pattern, row_number() over (partition by requested order by pattern <> requested, pattern_order) as co from (select distinct requested from poems) n, (select distinct pattern, pattern_order from slots) p
  where {core.format("requested")} = {core.format("pattern")} or (length(requested) >= 2 and (contains(pattern, requested) or contains(requested, pattern)))),
t as (select poem_id, requested, regexp_extract_all(coalesce(content, ''), '[一-龥〇]') as cs from poems),
tried as (select poem_id, t.requested, cs, len(cs) as n_chars, r.pattern, r.co, v.variant, v.n_slots from t left join routed r using (requested) left join variants v on v.pattern = r.pattern),
placed as (select poem_id, pattern, variant, unnest(cs) as ch, unnest(range(len(cs))) as pos from tried where n_slots = n_chars),
rows as (select p.*, s.tune, s.is_rhyme, c.flat is not null as known, case when s.tune = '平' then c.flat else c.oblique end as fits from placed p join slots s using (pattern, variant, pos) left join chars c on c.ch = p.ch),
pointed as (select *, case when known and not fits and is_rhyme then 4 when known and not fits and tune in ('平', '仄') then 3 else 0 end as points, coalesce(known and fits and is_rhyme, false) as hits from rows),
heard as (select p.*, case when hits then (select min_by(g, place) from readings r where r.ch = p.ch and (r.tone = '平') = (p.tune = '平')) end as g,
  case when hits then (select min_by(label, place) from readings r where r.ch = p.ch and (r.tone = '平') = (p.tune = '平')) end as gl from pointed p),
anchored as (select *, first_value(g ignore nulls) over o as anchor, first_value(gl ignore nulls) over o as anchor_label from heard window o as (partition by poem_id, pattern, variant, tune = '平' order by pos)),
final as (select *, {broken if strict else "points"} as pts from anchored p),
totals as (select poem_id, pattern, variant, sum(pts) as points, count(*) filter (pts > 0) as errors, count(*) filter (not known) as warnings,
  coalesce(string_agg(label, ' | ' order by first_pos) filter (label is not null), '') as label
  from final left join (select poem_id as i, pattern as pa, variant as va, '平水韵·' || anchor || '韵' as label, min(pos) as first_pos from anchored where hits group by all) l
  on l.i = poem_id and l.pa = pattern and l.va = variant and l.first_pos = pos group by all),
judged as (select t.*, case when n_slots = n_chars then greatest(0, 100 - 4 * coalesce(points, 0)) else 0 end as score, case when n_slots = n_chars then errors else 1 end as errors,
  case when n_slots = n_chars then warnings else 0 end as warnings, coalesce(label, '') as label from tried t left join totals using (poem_id, pattern, variant)),
best as (select *, row_number() over (partition by poem_id order by score desc, abs(n_slots - n_chars) nulls last, errors, co nulls last, variant nulls last) as r from judged)
select poem_id, requested, pattern, variant, score::int as score, score >= 60 as valid, errors::int as errors, warnings::int as warnings, label, coalesce(pattern <> requested and score > 0, false) as corrected from best where r = 1"""


def _scored(spark, strict):
    slots, chars = lexicon(spark)
    poems = spark.createDataFrame(list(POEMS), "poem_id int, requested string, content string")
    return prosody.score(poems, slots, chars, strict)


@query(_prosody_sql(False))
def prosody_score(spark, sf_dir):
    return _scored(spark, False)


@query(_prosody_sql(True))
def prosody_score_strict(spark, sf_dir):
    return _scored(spark, True)


TUNES = ("木兰花", "减字木兰花", "浪淘沙", "浪淘沙慢", "祝英台近", "水调歌头", "如梦令")


@query(f"""
with p(pattern, o) as (values {_values([(t, i) for i, t in enumerate(TUNES)])}), n(requested) as (values ('木兰花'), ('浪淘沙令'), ('水调歌'), ('祝英台')),
c as (select *, regexp_replace(requested, '^(摊破|减字|偷声|促拍|添字)|(令|引|近|慢|犯)$', '', 'g') as a, regexp_replace(pattern, '^(摊破|减字|偷声|促拍|添字)|(令|引|近|慢|犯)$', '', 'g') as b from n, p)
select requested, pattern, row_number() over (partition by requested order by pattern <> requested, o)::int as candidate_order from c
where a = b or (length(requested) >= 2 and (contains(pattern, requested) or contains(requested, pattern)))""")
def tune_family_match(spark, sf_dir):
    patterns = spark.createDataFrame([(t, i) for i, t in enumerate(TUNES)], "pattern string, pattern_order int")
    names = spark.createDataFrame([("木兰花",), ("浪淘沙令",), ("水调歌",), ("祝英台",)], "requested string")
    return prosody.families(names, patterns)


LEFT, RIGHT = (("一东", "东风"), ("二冬", "冬a农")), (("一东", "风中a"), ("三江", "江，江"))


@query(f"""
with a(k, t) as (values {_values(LEFT)}), b(k, t) as (values {_values(RIGHT)}),
j as (select coalesce(a.k, b.k) as k, regexp_extract_all(coalesce(a.t, '') || coalesce(b.t, ''), '[一-龥〇]') as cs from a full join b on a.k = b.k),
e as (select k, unnest(cs) as ch, unnest(range(len(cs))) as i from j), d as (select k, ch, min(i) as i from e group by all)
select k as key, string_agg(ch, '' order by i) as chars from d group by k""")
def dictionary_merge(spark, sf_dir):
    a, b = (spark.createDataFrame(list(rows), "key string, chars string") for rows in (LEFT, RIGHT))
    return tables.merge_dictionaries(a, b, "key", "chars")


MESSAGES = ("「风」平声（平），此处须填仄声字", "「动」上声（仄），此处须填平声字", "「X」未收录于平水韵（已跳过该字校验，不扣分）", "「送」去声，此韵脚须平声", "字数不符：该变体要求 3 字", "💡 智能纠偏：已匹配", "出韵：属江韵", "别的")


@query(f"""
with m(message) as (values {_values([(m,) for m in MESSAGES])})
select message, case when contains(message, '字数不符') then 'length_mismatch' when contains(message, '智能纠偏') then 'variant_autocorrect' when contains(message, '韵脚') then 'rhyme_mismatch'
  when contains(message, '须填平声字') then 'tone_expected_flat' when contains(message, '须填仄声字') then 'tone_expected_oblique' when contains(message, '出韵') or contains(message, '押') then 'rhyme_mismatch'
  when contains(message, '未收录') then 'unknown_char' else 'other' end as kind from m""")
def issue_classification(spark, sf_dir):
    return spark.createDataFrame([(m,) for m in MESSAGES], "message string").select("message", stats.issue_type(F.col("message")).alias("kind"))


ANSWERS = ('<think>x</think>{"cipai":"如梦令","title":"t","content":"c"} tail', '```json\n[{"id":1}]\n```', '{"id":2}', "noise [1,2] tail", "none")


@query("""
select * from (values (0, '如梦令', null, null), (1, null, '[{"id":1}]', '[{"id":1}]'), (2, null, '[{"id":2}]', '[{"id":2}]'), (3, null, '[1,2]', null), (4, null, null, null)) v(id, cipai, "array", native_array)""")
def llm_json_extract(spark, sf_dir):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS)], "id int, answer string")
    poem = text.llm_object(F.col("answer"), "cipai string, title string, content string")
    return rows.select("id", poem["cipai"].alias("cipai"), extract_json_array("answer").alias("array"), F.to_json(text.llm_array(F.col("answer"), "struct<id:int>")).alias("native_array"))


NUMERALS = ("六十六", "一百一十四", "十", "一百零五", "九", "二十", "一百")


@query(f"with v(numeral, n) as (values {_values(zip(NUMERALS, (66, 114, 10, 105, 9, 20, 100)))}) select numeral, n::int as n from v")
def chinese_numerals(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in NUMERALS], "numeral string").select("numeral", text.zh_number(F.col("numeral")).cast("int").alias("n"))


@query("""
select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text,
  regexp_replace(regexp_replace(lower(url), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from pages""")
def page_text_and_slug(spark, sf_dir):
    from cantorium.session import table

    return table(spark, sf_dir, "pages").select("page_id", text.normal_text(F.col("html")).alias("text"), text.slug(F.col("url")).alias("slug"))


@query("""
with w as (select time_bucket(interval '5 minutes', ts) as start, event_type, value from events)
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from w group by all""")
def windowed_event_counts(spark, sf_dir):
    from cantorium.session import table
    from cantorium.streaming.ingest import windowed_counts

    found = windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
