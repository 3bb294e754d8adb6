"""DuckDB SQL for the operators that SQL can express; parameters come from the operators' own constants."""

from __future__ import annotations

from cantorium.llm import licenses, mixing


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _inverse(curve: tuple[tuple[float, float], ...]) -> str:
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(curve, curve[1:])]
    want, done, arms = f"(y * {float(sum(areas))!r}::double)", 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(zip(curve, curve[1:]), areas):
        rest = f"greatest({want} - {done!r}::double, 0.0::double)"
        root = f"sqrt(greatest({w0 * w0!r}::double + {2 * (w1 - w0) / (t1 - t0)!r}::double * {rest}, 0.0::double))"
        time = f"{t0!r}::double + case when {w0!r}::double + {root} > 0 then 2.0::double * {rest} / ({w0!r}::double + {root}) else 0.0::double end"
        done += area
        arms.append(f"when {want} < {done!r}::double then least({time}, {t1!r}::double)")
    return f"case {' '.join(arms)} else {curve[-1][0]!r}::double end"


def _mixing() -> str:
    weights, most = mixing.WEIGHTS, mixing.MOST_REPEATS
    places = " union all ".join(f"select *, {k} as pass, source_size * {float(k)!r}::double + at_word + size / 2.0::double as middle from placed" for k in range(most))
    kinds = " ".join(f"when kind = {k} then {_inverse(c)}" for k, c in enumerate(mixing.CURVES))
    return f"""
with sized as (
  select doc_id, source, coalesce('a' || source, 'b') as source_key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as k
  from documents),
totals as (select source_key, sum(size)::bigint as source_size from sized group by source_key),
ranked as (select *, ((row_number() over (order by source_key) - 1) % {len(weights)})::int as kind from totals),
weighed as (
  select *, [{", ".join(f"{float(w)!r}::double" for w in weights)}][kind + 1] as w, source_size * {float(most)!r}::double as lim from ranked),
levels as (select *, lim / w as level from weighed),
sums as (
  select *, sum(w) over () as all_w, (sum(source_size) over ())::double as all_size,
    coalesce(sum(w) over o, 0.0::double) as w_before, coalesce(sum(lim) over o, 0.0::double) as lim_before
  from levels window o as (order by level, source_key rows between unbounded preceding and 1 preceding)),
cut as (select *, (all_size - lim_before) / (all_w - w_before) > level as limited from sums),
goals as (
  select source_key, source_size, kind, case when limited then lim else
    w * ((all_size - sum(case when limited then lim else 0 end) over ()) / (all_w - sum(case when limited then w else 0 end) over ())) end as target
  from cut),
placed as (
  select s.*, g.source_size, g.kind, g.target,
    coalesce(sum(size) over (partition by s.source_key order by k, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as at_word
  from sized s join goals g using (source_key)),
passes as ({places}),
taken as (
  select source_key, doc_id, size, source_size, target, at_word,
    count(*) filter (middle < target) as copies, min(middle / target) filter (middle < target) as y, any_value(kind) as kind
  from passes group by all),
gaps as (select source_key, any_value(target) - sum(size * copies) as gap from taken group by source_key),
useful as (
  select source_key, min(struct_pack(miss := abs(size - abs(gap)), a := at_word, gap := gap)) as best
  from taken join gaps using (source_key)
  where size > 0 and abs(size - abs(gap)) < abs(gap) and ((copies < {most} and gap > 0) or (copies > 0 and gap < 0))
  group by source_key),
final as (
  select t.*, case when u.best is null or size = 0 or at_word <> u.best.a then 0 when u.best.gap > 0 then 1 else -1 end as change
  from taken t left join useful u using (source_key))
select doc_id, size, source_size, target, (size * (copies + change))::bigint as taken,
  round(case when copies + change = 0 then null when copies = 0 then 1.0::double else (case {kinds} end) end, 6) as first_position
from final"""


def _canonical(text: str) -> str:
    plain = f"lower(coalesce({text}, ''))"
    plain = f"regexp_replace({plain}, '(?m){licenses.COPYRIGHT}', '\\1', 'g')"
    plain = f"regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for left, right in licenses._WORDS:
        plain = f"replace({plain}, '{left}', '{right}')"
    return f"trim(regexp_replace({plain}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


def _digest(plain: str) -> str:
    flat = f"replace({plain}, chr(10), ' ')"
    for left, right in licenses._PHRASES:
        flat = f"replace({flat}, '{left}', '{right}')"
    return f"case when {plain} <> '' then sha256({flat}) end"


def _licenses() -> str:
    texts = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.variants())
    digests = ", ".join(f"({_quoted(name)}, {_quoted(d)})" for name, d in licenses.KNOWN_DIGESTS)
    return f"""
with known_texts(licence, known_text) as (values {texts}),
known_digests(licence, known_digest) as (values {digests}),
known_plain as (select licence, {_canonical("known_text")} as plain from known_texts),
known as (select known_digest, min(licence) as licence from (select licence, {_digest("plain")} as known_digest from known_plain union all from known_digests) group by 1),
plain as (select row_number() over () as row_id, doc_id, {_canonical("text")} as plain from documents),
whole as (select row_id, doc_id, {_digest("plain")} as text_digest from plain),
lines as (select row_id, unnest(string_split(plain, chr(10))) as line from plain),
listed as (
  select row_id, list_sort(list(distinct licence)) as listed
  from (select row_id, {_digest("line")} as line_digest from lines) join known on line_digest = known_digest group by row_id)
select doc_id, text_digest, licence, coalesce(array_to_string(listed, ','), '') as notices, coalesce(len(listed), 0)::bigint as n_notices
from whole left join known on text_digest = known_digest left join listed using (row_id)"""


_FINITE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

TOP_K = f"""
with points as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where vec_id is not null and {_FINITE}),
pairs as (
  select q.vec_id as query_id, p.vec_id, list_inner_product(q.v::double[], p.v::double[])::bigint as score
  from points q join points p on q.vec_id <> p.vec_id where q.vec_id % 100 = 0),
ranked as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10"""

VECTOR_DUPLICATES = f"""
with recursive good as (
  select vec_id, embedding::double[] as e from embeddings
  where {_FINITE} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)
select vec_id, (select count(*) from links where a = vec_id) as n_links,
  least(vec_id, coalesce((select min(b) from reach where a = vec_id), vec_id)) as component_id,
  vec_id = least(vec_id, coalesce((select min(b) from reach where a = vec_id), vec_id)) as kept
from embeddings"""

MIXING = _mixing()
LICENSES = _licenses()
