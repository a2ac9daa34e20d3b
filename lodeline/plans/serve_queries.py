"""Queries of the comparison driver, its served answers, and the comparison of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import positive
from ..operators import panel as P
from ..operators import serve as S
from ..session import table
from .compare_queries import _GRID
from .guard_queries import GUARD
from .queries import MAIN, query, r6

W = "case when pv > 0 and not isnan(pv) then pv end"


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return S.comparison(table(spark, d, MAIN), ["own_leaf"], "own_run", positive(F.col("pv")))


@query("answer_overview", f"select own_run snap, count(*) n, count(distinct own_leaf) own_leaf_classes, count(own_leaf) own_leaf_rows, count(distinct l2) l2_classes, count(l2) l2_rows from {MAIN} where own_run is not null group by own_run")
def answer_overview(spark: SparkSession, d: str) -> DataFrame:
    return S.overview(table(spark, d, MAIN), ["own_leaf", "l2"], "own_run")


@query("answer_findings", _GRID + """
, s as (select cls, snap_a, snap_b, p_a, p_b, d, lo, hi, row_number() over (order by abs(d) desc, cls, snap_a, snap_b) place, case when n_a > 0 and n_b > 0 then 'shared' when n_a > 0 then 'a only' when n_b > 0 then 'b only' else 'neither' end occurs from pr where lo > 0 or hi < 0)
select cls, snap_a, snap_b, round(p_a, 6) p_a, round(p_b, 6) p_b, round(d, 6) d, round(lo, 6) lo, round(hi, 6) hi, true significant, occurs, place from s where place <= 6""")
def answer_findings(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.findings(_tables(spark, d), "own_leaf"), "p_a", "p_b", "d", "lo", "hi")


@query("answer_class_detail", _GRID + """

select cls, snap, n::bigint n, n_snap::bigint n_snap, round(p, 6) p, round(lo, 6) lo, round(hi, 6) hi, round(max(p) over (partition by cls) - min(p) over (partition by cls), 6) "range", n = 0 absent from wi where cls = 'mock tests'""")
def answer_class_detail(spark: SparkSession, d: str) -> DataFrame:
    t = S.class_detail(_tables(spark, d), "own_leaf", "mock tests")
    return r6(t.select("cls", "snap", "n", "n_snap", "p", "lo", "hi", "range", "absent"), "p", "lo", "hi", "range")


_HITS = [*GUARD.hard.values(), *GUARD.declared]


@query("answer_scrubbed", f"select row_id, case when {' or '.join(f'''coalesce(regexp_matches(query, '{p}'), false)''' for p in _HITS)} or {' or '.join(f'''coalesce(regexp_matches(query, '{a}') and regexp_matches(query, '{b}'), false)''' for a, b in GUARD.together)} then '{S.BLOCKED}' else query end query, case when not isnan(pv) then pv end pv from {MAIN}")
def answer_scrubbed(spark: SparkSession, d: str) -> DataFrame:
    return S.scrub(table(spark, d, MAIN).select("row_id", "query", "pv"), GUARD)


@query("class_enriched", f"""
with c as (select own_leaf cls, l2 other, count(*) n from {MAIN} where own_leaf is not null group by all),
m as (select cls, sum(n)::bigint n, sum(case when other is not null then n else 0 end) known from c group by cls), b as (select cls, other, n, row_number() over (partition by cls order by n desc, other) r from c where other is not null),
x as (select own_leaf cls, row_id, row_number() over (partition by own_leaf order by coalesce({W}, 0) desc, row_id) r from {MAIN} where own_leaf is not null and not regexp_matches(query, '@|[0-9]{{6}}')),
e as (select cls, string_agg(row_id::varchar, ',' order by r) examples from x where r <= 3 group by cls)
select m.cls, m.n, b.other dominant, round(b.n / m.known::double, 6) share, examples from m left join b on m.cls = b.cls and b.r = 1 left join e on m.cls = e.cls""")
def class_enriched(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.enrich(table(spark, d, MAIN), "own_leaf", "l2", "row_id", ~F.col("query").rlike("@|[0-9]{6}"), positive(F.col("pv"))), "share")


@query("dominant_label", f"""
with t as (select query "key", own_leaf label, sum(coalesce({W}, 0)) w from {MAIN} where query is not null and own_leaf is not null group by all), r as (select *, row_number() over (partition by "key" order by w desc, label) r, count(*) over (partition by "key") c from t)
select "key", label, c > 1 conflict from r where r = 1""")
def dominant_label(spark: SparkSession, d: str) -> DataFrame:
    return S.dominant_label(table(spark, d, MAIN), "query", "own_leaf", positive(F.col("pv")))


@query("disagreement_batches", "with d as (select idx id, least(label_a, label_b) class_a, greatest(label_a, label_b) class_b from gold_rows where label_a <> label_b) select class_a, class_b, ((row_number() over (partition by class_a, class_b order by id) - 1) // 15)::bigint batch, id from d")
def disagreement_batches(spark: SparkSession, d: str) -> DataFrame:
    return S.disagreement_batches(table(spark, d, "gold_rows"), "idx", "label_a", "label_b")


@query("naming_shards", f"select own_leaf, n, ((row_number() over (order by own_leaf) - 1) % 5)::bigint shard from (select own_leaf, count(*) n from {MAIN} where own_leaf is not null group by own_leaf)")
def naming_shards(spark: SparkSession, d: str) -> DataFrame:
    return S.shards(table(spark, d, MAIN).where("own_leaf is not null").groupBy("own_leaf").agg(F.count("*").alias("n")), "own_leaf")


@query("locator_reach", f"""
with c as (select own_leaf c, count(*) n, count(core) k from {MAIN} where own_leaf is not null group by own_leaf)
select round(avg((k >= 0.1 * n)::int), 6) reach, round(sum(case when k >= 0.1 * n then n else 0 end) / sum(n)::double, 6) mass, sum((k >= 0.1 * n)::int)::bigint clusters_reached, count(*) clusters, round(sum(k) / sum(n)::double, 6) row_coverage from c""")
def locator_reach(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.locator_reach(table(spark, d, MAIN), "own_leaf", "core"), "reach", "mass", "row_coverage")


_CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Co", "Cs")


@query("char_categories", "with t as (select coalesce(string_agg(query, ''), '') s from " + MAIN + "), c as (" + " union all ".join(f"select '{k}' category, length(regexp_replace(s, '[^\\p{{{k}}}]', '', 'g'))::bigint n, length(s) a from t" for k in _CATEGORIES if k != "Cs") + ") select category, n, round(n / a::double, 6) share from c where n > 0")
def char_categories(spark: SparkSession, d: str) -> DataFrame:
    return r6(S.char_categories(table(spark, d, MAIN), "query"), "share")


@query("inputs_shared_texts", """
with t as (select distinct source_file s, query from prepared_corpus where source_file is not null and query is not null), o as (select s, count(*) n from t group by s)
select x.s a, y.s b, max(o.n) n_a, max(p.n) n_b, count(*) shared from t x join t y on x.query = y.query and x.s < y.s join o on o.s = x.s join o p on p.s = y.s group by x.s, y.s""")
def inputs_shared_texts(spark: SparkSession, d: str) -> DataFrame:
    return S.shared_texts(table(spark, d, "prepared_corpus"), "source_file", "query")


@query("geometric_audit", """
with u as (select vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) v from embeddings),
p as (select label, i, sum(v[i]) x, count(*) n from u, unnest(generate_series(1, 64)) g(i) group by label, i), s as (select label, max(n) n, list(x order by i) s from p group by label),
h as (select a.vec_id q, a.label ql, b.label bl, row_number() over (partition by a.vec_id order by round(list_dot_product(a.v, b.v), 6) desc, b.vec_id) place from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
a as (select ql, avg(d) agreement from (select q, ql, avg((ql = bl)::int) d from h where place <= 5 group by q, ql) group by ql),
j as (select s.label, s.n, case when n > 1 then (list_dot_product(s, s) - n) / (n::double * (n - 1)) end cohesion, agreement from s join a on a.ql = s.label),
m as (select median(agreement) md from j), b as (select md, median(abs(agreement - md)) mad, sum(n) t, count(*) c from j, m group by md)
select label::varchar cls, n, round(cohesion, 6) cohesion, round(agreement, 6) agreement, round(greatest(2 * n / t::double, case when c >= 5 then md - mad else 0.5 end), 6) bar, case when agreement >= greatest(2 * n / t::double, case when c >= 5 then md - mad else 0.5 end) then 'visible' else 'needs rules' end verdict from j, b""")
def geometric_audit(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the nearest is taken for the rows whose id is divisible by 20, searched in all rows."""
    e = table(spark, d, "embeddings")
    return r6(P.geometric_audit(e, "vec_id", "embedding", "label", e.where("vec_id % 20 = 0")), "cohesion", "agreement", "bar")
