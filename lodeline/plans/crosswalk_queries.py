"""Queries of the crosswalk operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import positive
from ..operators import crosswalk as X
from ..operators.compare import snapshots_of
from ..session import table
from .queries import MAIN, query, r6

W = "case when pv > 0 and not isnan(pv) then pv end"
_FACETS = {"question": "[?？]", "grade": "年级|grade [0-9]", "courtesy": "谢谢|please|thanks"}


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, MAIN)


@query("delivered_crosswalk", f"""
with c as (select own_leaf family, upper(trim(u_ds)) intent, count(*) n from {MAIN} where own_leaf is not null and u_ds is not null group by all), x as (select *, sum(n) over (partition by family)::double t, row_number() over (partition by family order by n desc, intent) r from c)
select family, max(t)::bigint n, max(case when r = 1 then intent end) dominant, round(max(case when r = 1 then n / t end), 6) share, round(exp(-sum(n/t*ln(n/t))), 6) effective, case when max(case when r = 1 then n / t end) >= 0.8 then 'one to one' when max(case when r = 1 then n / t end) >= 0.5 then 'mostly' else 'mixed' end verdict from x group by family""")
def delivered_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.crosswalk(_rows(spark, d).withColumn("u", F.upper(F.trim("u_ds"))), "own_leaf", "u"), "share", "effective")


@query("facet_shares", "with f as (" + " union all ".join(f"select own_leaf cls, own_run snap, '{k}' facet, sum(coalesce(regexp_matches(query, '{p}'), false)::int)::bigint k, count(*)::double n from {MAIN} where own_leaf is not null and own_run is not null group by own_leaf, own_run" for k, p in _FACETS.items()) + """), x as (select *, k / n p, 1.959964e0 z from f)
select cls, snap, facet, k, n::bigint n, round(p, 6) p, round(greatest(0e0, (p + z*z/(2*n))/(1 + z*z/n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))/(1 + z*z/n)), 6) lo, round(least(1e0, (p + z*z/(2*n))/(1 + z*z/n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))/(1 + z*z/n)), 6) hi from x""")
def facet_shares(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.facet_shares(_rows(spark, d), "own_leaf", "own_run", "query", _FACETS), "p", "lo", "hi")


@query("minority_dilution", f"""
with c as (select own_leaf label, count(*)::double n, sum((tier = 'headline')::int)::bigint k from {MAIN} where own_leaf is not null group by own_leaf having sum((tier = 'headline')::int) > 0), t as (select *, sum(k) over ()::double a from c)
select max(a)::bigint "rows", round(max(k) / max(a), 6) in_largest, round(arg_max(k / n, (k, k / n)), 6) purity, count(*) touched, sum((k >= 0.05e0 * a)::int)::bigint with_5pct from t""")
def minority_dilution(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.minority_dilution(_rows(spark, d), "own_leaf", "tier", "headline"), "in_largest", "purity")


@query("tier_profile", f"""
with c as (select tier kind, count(*) n from {MAIN} group by tier), x as (select *, n / sum(n) over ()::double share, row_number() over (order by n desc, kind) r from c) select kind, n, round(share, 6) share, case when r = 1 then 'dominant' when share >= 0.005 then 'minority' else 'trace' end role from x""")
def tier_profile(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.kind_profile(_rows(spark, d), F.col("tier")), "share")


@query("leaves_per_family", f"select l2 family, count(distinct own_leaf) leaves, count(*) n from {MAIN} where own_leaf is not null and l2 is not null group by l2")
def leaves_per_family(spark: SparkSession, d: str) -> DataFrame:
    return X.leaves_per_family(_rows(spark, d), "own_leaf", "l2")


@query("similarity_bands", f"""
select case when length(query) < 6 then '<6' when length(query) < 12 then '<12' when length(query) < 24 then '<24' else '24+' end band, count(*) n, round(quantile_cont(sim, 0.5), 6) median, round(avg((sim < 0.7)::int), 6) low_share from {MAIN} where sim is not null and not isnan(sim) and query is not null group by 1""")
def similarity_bands(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.similarity_bands(_rows(spark, d), "sim", "query"), "median", "low_share")


_HEADS = f"with r as (select own_run grp, {W} w, row_number() over (partition by own_run order by {W} desc) r from {MAIN} where own_run is not null and {W} is not null)"


@query("tie_free_heads", _HEADS + ", b as (select grp, min(w) least_weight from r where r <= 100 group by grp) select grp, least_weight, count(*) head from r join b using (grp) where w >= least_weight group by all")
def tie_free_heads(spark: SparkSession, d: str) -> DataFrame:
    return X.tie_free_head(_rows(spark, d), "own_run", positive(F.col("pv")), 100)


@query("weight_concentration", _HEADS + " select grp, count(*) n, round(sum(case when r <= 10 then w else 0 end) / sum(w), 6) top_share from r group by grp")
def weight_concentration(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.weight_concentration(_rows(spark, d), "own_run", positive(F.col("pv"))), "top_share")


@query("mid_rank_percentiles", f"""
with c as (select own_run grp, length(query)::bigint x, count(*) c from {MAIN} where own_run is not null and query is not null group by all)
select grp, x, round((sum(c) over (partition by grp order by x rows unbounded preceding) - c + c / 2e0) / sum(c) over (partition by grp), 6) percentile from c""")
def mid_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.mid_rank(_rows(spark, d).withColumn("x", F.length("query").cast("bigint")), "own_run", "x"), "percentile")


@query("depth_controlled_distance", f"""
with ab as (select own_run, row_number() over (order by own_run) o from (select distinct own_run from {MAIN} where own_run is not null)),
m as (select own_leaf cls, o, {W} w from {MAIN} join ab using (own_run) where o <= 2 and own_leaf is not null), r as (select o, w, row_number() over (partition by o order by w desc) r from m where w is not null), b as (select o, min(w) lw from r where r <= 200 group by o),
g as (select cls, sum((m.o = 1)::int)::double a, sum((m.o = 2)::int)::double b, sum((m.o = 1 and coalesce(w >= lw, false))::int)::double ha, sum((m.o = 2 and coalesce(w >= lw, false))::int)::double hb from m left join b on m.o = b.o group by cls)
select round(sum(abs(a / sa - b / sb)) / 2, 6) tvd, round(sum(abs(ha / sha - hb / shb)) / 2, 6) tvd_head from g, (select sum(a) sa, sum(b) sb, sum(ha) sha, sum(hb) shb from g)""")
def depth_controlled_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    a, b = snapshots_of(rows, "own_run")[:2]
    return r6(X.depth_control(rows, "own_leaf", "own_run", positive(F.col("pv")), a, b, 200), "tvd", "tvd_head")
