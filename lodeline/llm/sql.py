"""SQL for the queries that DuckDB can express over whole tables."""

from __future__ import annotations

MAIN = "sva_dom_edu_wraps_head"

_P2 = f"""
with once as (select * from (select *, row_number() over (partition by rec_key, case when rec_key is null then row_id end order by row_id) d from {MAIN} where surface is not null and own_run is not null and pv > 0 and not isnan(pv)) where d = 1),
r as (select surface, own_run, row_id, row_number() over (partition by surface, own_run order by pv desc, rank asc nulls last, row_id) place from once)
select surface, own_run, row_id, place from r where place <= 3"""

_IGNORED = r"[\p{P}\p{Z}\p{C}]+"
_FIELD = r"[^:：;；,，\n]+[:：][^:：;；,，\n]+"


def _plain(c: str) -> str:
    return f"regexp_replace(lower(upper(replace(replace({c}, 'ß', 'ss'), 'ẞ', 'ss'))), '{_IGNORED}', '', 'g')"


_FORMS = rf"""
with t as (select row_id, own_run, pv, query, regexp_replace(query, '^[\p{{P}}\p{{Z}}\p{{C}}]+|[\p{{P}}\p{{Z}}\p{{C}}]+$', '', 'g') trimmed from {MAIN} where query is not null and own_run is not null and pv is not null and not isnan(pv)),
f as (select *, case when regexp_matches(trimmed, '^{_FIELD}(?:[;；,，\n]+{_FIELD})+[;；,，\n\s]*$') then
  '|' || array_to_string(list_sort(list_transform(list_filter(string_split_regex(trimmed, '[;；,，\n]+'), lambda x: length({_plain('x')}) > 0), lambda x: {_plain("regexp_extract(x, '^([^:：]*)', 1)")} || '=' || {_plain("regexp_extract(x, '[:：](.*)$', 1)")})), '|')
  else {_plain('query')} end form from t)"""

_P6 = f"""{_FORMS},
g as (select row_id, min(row_id) over (partition by own_run, pv, form) first_row_id from f where form <> '')
select first_row_id, row_id from g where first_row_id <> row_id"""

_P6_COLLAPSED = f"""{_FORMS}
select min(row_id) first_row_id, count(*) n_copies from f where form <> '' group by own_run, pv, form"""

# exact lists of a stated set of queries; the operator must reach 99 % of them
_P5_RECALL = """
with u as (select vec_id, list_transform(vec, lambda x: x::double) v from edu_query_vectors where vec is not null and len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0),
p as (select a.vec_id, b.vec_id nn, round(list_cosine_similarity(a.v, b.v), 6) s from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by vec_id order by s desc, nn) place from p where s >= 0.8)
select count(distinct vec_id) n_queries, count(*) n_rows, sum(nn)::bigint sum_of_ids, true recall_99 from r where place <= 5"""

_P8_DECODED = "select doc_id, coalesce(text, '') as text from documents"


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p5_recall": _P5_RECALL, "p6_found": _P6, "p6_collapsed": _P6_COLLAPSED, "p8_decoded": _P8_DECODED}
