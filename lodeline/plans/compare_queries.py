"""Queries of the comparison operators over the query table (class: leaf; snapshot: run; weight: page views)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import positive
from ..operators import compare as C
from ..session import table
from .queries import MAIN, query, r6

W = "case when pv > 0 and not isnan(pv) then pv else 0e0 end"
_GRID = f"""
with base as (select own_leaf cls, own_run snap, {W} w from {MAIN} where own_run is not null),
snaps as (select distinct snap from base), classes as (select distinct cls from base where cls is not null),
cells as (select cls, snap, count(*) n, sum(w) w from base where cls is not null group by cls, snap),
g0 as (select c.cls, s.snap, coalesce(x.n, 0) n, coalesce(x.w, 0) w from classes c cross join snaps s left join cells x on x.cls = c.cls and x.snap = s.snap),
g as (select *, sum(n) over (partition by snap)::double n_snap, sum(w) over (partition by snap) w_snap from g0),
gp as (select *, n / n_snap p, w / w_snap wp, 1.959964e0 z from g),
wi as (select *, greatest(0e0, (p + z*z/(2*n_snap))/(1 + z*z/n_snap) - z*sqrt(p*(1-p)/n_snap + z*z/(4*n_snap*n_snap))/(1 + z*z/n_snap)) lo,
       least(1e0, (p + z*z/(2*n_snap))/(1 + z*z/n_snap) + z*sqrt(p*(1-p)/n_snap + z*z/(4*n_snap*n_snap))/(1 + z*z/n_snap)) hi from gp),
ab as (select *, row_number() over (order by snap) o from snaps),
pr as (select a.cls, a.snap snap_a, b.snap snap_b, a.n n_a, b.n n_b, a.n_snap t_a, b.n_snap t_b, a.p p_a, b.p p_b, a.wp wp_a, b.wp wp_b,
       b.p - a.p d, (b.p - a.p) - sqrt(power(b.p - b.lo, 2) + power(a.hi - a.p, 2)) lo, (b.p - a.p) + sqrt(power(b.hi - b.p, 2) + power(a.p - a.lo, 2)) hi
       from wi a join wi b on a.cls = b.cls and a.snap < b.snap)
"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, MAIN)


def _weight():
    return positive(F.col("pv"))


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    rows = _rows(spark, d)
    snaps = C.snapshots_of(rows, "own_run")
    return C.grid(rows, "own_leaf", "own_run", snaps, _weight()), snaps


@query("class_matrix", _GRID + """
select cls, snap, n::bigint n, n_snap::bigint n_snap, round(p, 6) p, round(lo, 6) lo, round(hi, 6) hi, round(wp, 6) wp,
  round(p / (sum(n) over (partition by cls) / sum(n_snap) over (partition by cls)), 6) "index",
  round(p / avg(p) over (partition by cls), 6) balanced_index,
  rank() over (partition by snap order by round(p, 3) desc)::bigint rank,
  sum(case when n > 0 then 1 else 0 end) over (partition by cls)::bigint present_in,
  round(max(p) over (partition by cls) - min(p) over (partition by cls), 6) "range",
  round(max(p) over (partition by cls) / nullif(min(p) over (partition by cls), 0), 6) ratio from wi""")
def class_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = C.matrix(_grid(spark, d)[0])
    return r6(m.withColumn("rank", F.col("rank").cast("bigint")).withColumn("present_in", F.col("present_in").cast("bigint")), "p", "lo", "hi", "wp", "index", "balanced_index", "range", "ratio")


@query("class_coverage", _GRID + """
, r as (select *, row_number() over (partition by snap order by n desc, cls) r from gp)
select snap, max(n_snap)::bigint n, sum(case when n > 0 then 1 else 0 end)::bigint classes, round(-sum(case when p > 0 then p*ln(p) else 0 end), 6) entropy,
 round(sum(p*p), 6) hhi, round(sum(case when r <= 1 then p else 0 end), 6) top1, round(sum(case when r <= 3 then p else 0 end), 6) top3, round(sum(case when r <= 5 then p else 0 end), 6) top5,
 round(exp(-sum(case when p > 0 then p*ln(p) else 0 end)), 6) effective from r group by snap""")
def class_coverage(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.coverage(_grid(spark, d)[0]), "entropy", "hhi", "top1", "top3", "top5", "effective")


@query("class_absence", f"""
with base as (select u_ds cls, surface snap from {MAIN} where surface in ('assistant_top1k', 'assistant_random1k', 'search_top10k', 'search_top1000') and u_ds is not null),
snaps as (select distinct snap from base), classes as (select distinct cls from base), cells as (select cls, snap, count(*) n from base group by all),
g0 as (select c.cls, s.snap, coalesce(x.n, 0) n from classes c cross join snaps s left join cells x on x.cls = c.cls and x.snap = s.snap),
g as (select *, sum(n) over (partition by snap)::double n_snap from g0),
r as (select *, (sum(n) over (partition by cls) - n) / (sum(n_snap) over (partition by cls) - n_snap) ref, first_value(snap) over (partition by cls order by n / n_snap desc, snap desc) densest from g)
select cls, snap, n_snap::bigint n_snap, round(ref, 6) ref, round(ref * n_snap, 6) expected, round(power(1 - ref, n_snap), 6) p_zero, round(1 - power(0.025e0, 1 / n_snap), 6) upper, densest,
 case when ref * n_snap >= 5 and power(1 - ref, n_snap) < 0.01 then 'true absence' when ref * n_snap < 3 then 'undecidable' else 'weak' end verdict from r where n = 0""")
def class_absence(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    g = C.grid(rows, "u_ds", "surface", ["assistant_random1k", "assistant_top1k", "search_top1000", "search_top10k"])
    return r6(C.absence(g), "ref", "expected", "p_zero", "upper")


@query("pairwise_change_newcombe", _GRID + """
select cls, snap_a, snap_b, round(p_a, 6) p_a, round(p_b, 6) p_b, round(d, 6) d, round(lo, 6) lo, round(hi, 6) hi, (lo > 0 or hi < 0) significant,
 case when n_a > 0 and n_b > 0 then 'shared' when n_a > 0 then 'a only' when n_b > 0 then 'b only' else 'neither' end occurs from pr""")
def pairwise_change_newcombe(spark: SparkSession, d: str) -> DataFrame:
    g, snaps = _grid(spark, d)
    return r6(C.pairwise_change(g, snaps), "p_a", "p_b", "d", "lo", "hi")


@query("pairwise_distance", _GRID + """
, rk as (select *, rank() over (partition by snap_a, snap_b order by n_a) + (count(*) over (partition by snap_a, snap_b, n_a) - 1) / 2e0 ra,
   rank() over (partition by snap_a, snap_b order by n_b) + (count(*) over (partition by snap_a, snap_b, n_b) - 1) / 2e0 rb,
   row_number() over (partition by snap_a, snap_b order by n_a desc, cls) ta, row_number() over (partition by snap_a, snap_b order by n_b desc, cls) tb, (n_a + n_b)::double rw, t_a + t_b t from pr)
select snap_a, snap_b, round(sum(abs(p_a - p_b)) / 2, 6) tvd, round(sum(abs(wp_a - wp_b)) / 2, 6) tvd_weight,
 round(sqrt(sum(case when rw > 0 then power(n_a - rw*t_a/t, 2) / (rw*t_a/t) + power(n_b - rw*t_b/t, 2) / (rw*t_b/t) else 0 end) / max(t)), 6) v, round(corr(ra, rb), 6) rho,
 sum(case when ta <= 5 and tb <= 5 then 1 else 0 end)::bigint top5_common, max(case when ta = 1 and tb = 1 then 1 else 0 end) = 1 same_leader from rk group by snap_a, snap_b""")
def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    g, snaps = _grid(spark, d)
    return r6(C.pairwise_distance(g, snaps), "tvd", "tvd_weight", "v", "rho")


@query("distance_noise_bounds")
def distance_noise_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval and noise ceiling of the distance of each pair of runs; from the collected grid of counts."""
    g, snaps = _grid(spark, d)
    counts: dict[str, dict[str, int]] = {}
    for r in g.select("cls", "snap", "n").collect():
        counts.setdefault(r.cls, {})[r.snap] = int(r.n)
    order = sorted(counts)
    rows = []
    for i, a in enumerate(snaps):
        for b in snaps[i + 1 :]:
            x = C.distance_bounds([counts[c][a] for c in order], [counts[c][b] for c in order], f"{a}|{b}")
            rows.append((a, b, x["tvd"], x["lo"], x["hi"], x["ceiling"], x["exceeds_noise"]))
    return spark.createDataFrame(rows, "snap_a string, snap_b string, tvd double, lo double, hi double, ceiling double, exceeds_noise boolean")


@query("signature_classes", _GRID + """
, w2 as (select a.cls, a.snap, a.p, (a.p - b.p) - sqrt(power(a.p - a.lo, 2) + power(b.hi - b.p, 2)) lo, (a.p - b.p) + sqrt(power(a.hi - a.p, 2) + power(b.p - b.lo, 2)) hi from wi a join wi b on a.cls = b.cls and a.snap <> b.snap),
s as (select cls, snap, max(p) p, min(lo) lowest, max(hi) highest from w2 group by cls, snap)
select cls, snap, round(p, 6) p, case when lowest > 0 then 'above' else 'below' end side, round(case when lowest > 0 then lowest else highest end, 6) weakest from s where lowest > 0 or highest < 0""")
def signature_classes(spark: SparkSession, d: str) -> DataFrame:
    g, snaps = _grid(spark, d)
    return r6(C.signature(g, snaps), "p", "weakest")


_SURFACES = {"assistant": ["assistant_random1k", "assistant_top1k"], "search": ["search_top1000", "search_top10k"]}
_SPLIT = f"""
with base as (select own_leaf cls, case when surface like 'assistant%' then 'assistant' else 'search' end grp from {MAIN} where surface in ('assistant_random1k', 'assistant_top1k', 'search_top1000', 'search_top10k') and own_leaf is not null),
t as (select grp, count(*)::double t from base group by grp),
c as (select cls, sum(case when grp = 'assistant' then 1 else 0 end)::bigint n_a, sum(case when grp = 'search' then 1 else 0 end)::bigint n_b from base group by cls),
x as (select c.*, a.t t_a, b.t t_b, n_a / a.t p1, n_b / b.t p2, 1.959964e0 z from c, t a, t b where a.grp = 'assistant' and b.grp = 'search'),
y as (select *, greatest(0e0, (p1 + z*z/(2*t_a) - z*sqrt(p1*(1-p1)/t_a + z*z/(4*t_a*t_a)))/(1 + z*z/t_a)) l1, least(1e0, (p1 + z*z/(2*t_a) + z*sqrt(p1*(1-p1)/t_a + z*z/(4*t_a*t_a)))/(1 + z*z/t_a)) u1,
 greatest(0e0, (p2 + z*z/(2*t_b) - z*sqrt(p2*(1-p2)/t_b + z*z/(4*t_b*t_b)))/(1 + z*z/t_b)) l2, least(1e0, (p2 + z*z/(2*t_b) + z*sqrt(p2*(1-p2)/t_b + z*z/(4*t_b*t_b)))/(1 + z*z/t_b)) u2,
 case when n_a = 0 then p2 when n_b = 0 then p1 end ref, case when n_a = 0 then t_a when n_b = 0 then t_b end size from x)
"""


@query("surface_split_two_groups", _SPLIT + """
select cls, 'assistant' group_a, 'search' group_b, n_a, n_b, round(p2 - p1, 6) d, round(p2 - p1 - sqrt(power(p2 - l2, 2) + power(u1 - p1, 2)), 6) lo, round(p2 - p1 + sqrt(power(u2 - p2, 2) + power(p1 - l1, 2)), 6) hi,
 case when ref is null then null when ref*size >= 5 and power(1 - ref, size) < 0.01 then 'true absence' when ref*size < 3 then 'undecidable' else 'weak' end verdict from y""")
def surface_split_two_groups(spark: SparkSession, d: str) -> DataFrame:
    g = C.grid(_rows(spark, d), "own_leaf", "surface", sum(_SURFACES.values(), []))
    return r6(C.surface_split(g, _SURFACES), "d", "lo", "hi")


@query("surface_many_groups", f"""
with base as (select own_leaf cls, case surface when 'assistant_top1k' then 'head' when 'search_top1000' then 'search' when 'search_top10k' then 'search' else 'random' end grp from {MAIN}
 where surface in ('assistant_random1k', 'assistant_top1k', 'search_top1000', 'search_top10k') and own_leaf is not null),
classes as (select distinct cls from base), t as (select grp, count(*) total from base group by grp), c as (select cls, grp, count(*) n from base group by all)
select k.cls, t.grp, coalesce(c.n, 0)::bigint n, t.total::bigint total, round(coalesce(c.n, 0) / t.total::double, 6) p from classes k cross join t left join c on c.cls = k.cls and c.grp = t.grp""")
def surface_many_groups(spark: SparkSession, d: str) -> DataFrame:
    g = C.grid(_rows(spark, d), "own_leaf", "surface", sum(_SURFACES.values(), []))
    return r6(C.surface_many(g, {"head": ["assistant_top1k"], "random": ["assistant_random1k"], "search": _SURFACES["search"]}), "p")


@query("exclusive_power", _SPLIT + """
, s as (select case when t_a <= t_b then 'assistant' else 'search' end smaller, case when t_a <= t_b then 'search' else 'assistant' end larger, case when t_a <= t_b then p1 else p2 end p, greatest(t_a, t_b) big, cls,
  case when t_a <= t_b then n_a else n_b end n from y),
r as (select * from s where n > 0 order by p, cls limit 1)
select smaller, larger, cls rarest, round(p * big, 6) expected, round(power(1 - p, big), 6) p_zero, power(1 - p, big) < 0.05 would_be_seen from r""")
def exclusive_power(spark: SparkSession, d: str) -> DataFrame:
    g = C.grid(_rows(spark, d), "own_leaf", "surface", sum(_SURFACES.values(), []))
    return r6(C.exclusive_power(g, _SURFACES), "expected", "p_zero")


@query("conditional_inner_mix", f"""
with ab as (select own_run, row_number() over (order by own_run) o from (select distinct own_run from {MAIN} where own_run is not null)),
c as (select own_leaf outer_, l2 inner_, sum(case when o = 1 then 1 else 0 end) n_a, sum(case when o = 2 then 1 else 0 end) n_b from {MAIN} join ab using (own_run) where o <= 2 and own_leaf is not null and l2 is not null group by all),
t as (select *, sum(n_a) over (partition by outer_)::double t_a, sum(n_b) over (partition by outer_)::double t_b from c)
select outer_ "outer", max(t_a)::bigint n_a, max(t_b)::bigint n_b, round(sum(abs(n_a / t_a - n_b / t_b)) / 2, 6) tvd, count(*) inner_classes from t where t_a >= 30 and t_b >= 30 group by outer_""")
def conditional_inner_mix(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    a, b = C.snapshots_of(rows, "own_run")[:2]
    return r6(C.conditional_mix(rows, "own_leaf", "l2", "own_run", a, b), "tvd")


@query("class_movement_two_periods", _GRID + """
select p.cls, n_a::bigint n_a, n_b::bigint n_b, round(p_a, 6) p_a, round(p_b, 6) p_b, round(d, 6) d, round(lo, 6) lo, round(hi, 6) hi, round(wp_b - wp_a, 6) d_weight,
 round(d / sqrt(((n_a + n_b) / (t_a + t_b)) * (1 - (n_a + n_b) / (t_a + t_b)) * (1 / t_a + 1 / t_b)), 6) z,
 case when n_a < 30 and n_b < 30 then 'thin' when least(n_a, n_b) / (n_a + n_b)::double <= 0.05 and n_a + n_b >= 30 and n_b > n_a then 'emergent' when least(n_a, n_b) / (n_a + n_b)::double <= 0.05 and n_a + n_b >= 30 then 'receded' else 'stable' end bucket
 from pr p join ab x on p.snap_a = x.snap and x.o = 1 join ab y on p.snap_b = y.snap and y.o = 2""")
def class_movement_two_periods(spark: SparkSession, d: str) -> DataFrame:
    g, snaps = _grid(spark, d)
    return r6(C.movement(g, snaps[0], snaps[1]), "p_a", "p_b", "d", "lo", "hi", "d_weight", "z")


@query("event_type_movement", """
with e as (select event_type cls, case when ts < timestamp '2024-01-16 00:00:00' then 'a' else 'b' end snap, coalesce(value, 0) w from events where event_type is not null),
t as (select sum(case when snap = 'a' then 1 else 0 end)::double ta, sum(case when snap = 'b' then 1 else 0 end)::double tb from e),
c as (select cls, sum(case when snap = 'a' then 1 else 0 end)::bigint n_a, sum(case when snap = 'b' then 1 else 0 end)::bigint n_b from e group by cls)
select cls, n_a, n_b, round(n_a / ta, 6) p_a, round(n_b / tb, 6) p_b, round(n_b / tb - n_a / ta, 6) d from c, t""")
def event_type_movement(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("snap", F.when(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), "a").otherwise("b"))
    g = C.grid(e, "event_type", "snap", ["a", "b"], F.col("value"))
    return r6(C.movement(g, "a", "b").select("cls", "n_a", "n_b", "p_a", "p_b", "d"), "p_a", "p_b", "d")


_AB = f"ab as (select own_run, row_number() over (order by own_run) o from (select distinct own_run from {MAIN} where own_run is not null)), m as (select *, {W} w from {MAIN} join ab using (own_run) where o <= 2)"


@query("class_delta_concentration", f"""
with {_AB}, t as (select own_leaf cls, query, abs(sum(case when o = 2 then w else -w end)) d from m where own_leaf is not null and query is not null group by all),
r as (select *, row_number() over (partition by cls order by d desc, query) r from t)
select cls, sum(d) moved, round(sum(case when r = 1 then d else 0 end) / sum(d), 6) top1, round(sum(case when r <= 5 then d else 0 end) / sum(d), 6) top5, round(sum(d*d) / (sum(d)*sum(d)), 6) hhi from r group by cls""")
def class_delta_concentration(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    a, b = C.snapshots_of(rows, "own_run")[:2]
    return r6(C.delta_concentration(rows, "own_leaf", "own_run", "query", _weight(), a, b), "top1", "top5", "hhi")


@query("snapshot_purity", _GRID + """
, f as (select snap from ab where o = 1)
select cls, sum(n)::bigint n, round(sum(case when snap in (from f) then n else 0 end) / sum(n)::double, 6) share_a,
 case when sum(case when snap in (from f) then n else 0 end) / sum(n)::double > 0.95 then 'nearly all' when sum(case when snap in (from f) then n else 0 end) / sum(n)::double < 0.05 then 'nearly none' else 'mixed' end verdict from g group by cls having sum(n) >= 30""")
def snapshot_purity(spark: SparkSession, d: str) -> DataFrame:
    g, snaps = _grid(spark, d)
    return r6(C.snapshot_purity(g, snaps[0]), "share_a")


@query("snapshot_inventory", f"select own_run snap, count(*) \"rows\", count(distinct query) distinct_texts, sum({W}) weight from {MAIN} group by own_run")
def snapshot_inventory(spark: SparkSession, d: str) -> DataFrame:
    return C.inventory(_rows(spark, d), "own_run", "query", _weight())


@query("query_churn", f"""
with {_AB}, t as (select query, max(case when o = 1 then 1 else 0 end) a, max(case when o = 2 then 1 else 0 end) b, sum(case when o = 1 then w else 0 end) wa, sum(case when o = 2 then w else 0 end) wb from m where query is not null group by query)
select sum(a)::bigint texts_a, sum(b)::bigint texts_b, sum(a*b)::bigint shared, round(sum(a*b) / count(*)::double, 6) jaccard, round(sum(a*b*wa) / sum(wa), 6) shared_weight_a, round(sum(a*b*wb) / sum(wb), 6) shared_weight_b from t""")
def query_churn(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    a, b = C.snapshots_of(rows, "own_run")[:2]
    return r6(C.churn(rows, "own_run", "query", _weight(), a, b), "jaccard", "shared_weight_a", "shared_weight_b")


@query("turnover_buckets", f"""
with {_AB}, t as (select query, min(own_leaf) cls, max(case when o = 1 then 1 else 0 end) a, max(case when o = 2 then 1 else 0 end) b from m where query is not null group by query),
c as (select case when a = 1 and b = 1 then 'stay' when a = 1 then 'gone' else 'new' end bucket, cls, count(*) n from t group by all)
select bucket, cls, n, round(n / sum(n) over (partition by bucket)::double, 6) share from c""")
def turnover_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    a, b = C.snapshots_of(rows, "own_run")[:2]
    return r6(C.turnover(rows, "own_leaf", "own_run", "query", a, b), "share")


@query("input_overlap_matrix", f"""
with t as (select distinct own_run, query from {MAIN} where query is not null and own_run is not null), n as (select own_run, count(*) n from t group by own_run),
c as (select a.own_run snap_a, b.own_run snap_b, count(*) common from t a join t b using (query) where a.own_run <> b.own_run group by all)
select x.own_run snap_a, y.own_run snap_b, coalesce(common, 0)::bigint common, round(coalesce(common, 0) / x.n::double, 6) overlap from n x join n y on x.own_run <> y.own_run left join c on c.snap_a = x.own_run and c.snap_b = y.own_run""")
def input_overlap_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return r6(C.overlap(rows, "own_run", "query", C.snapshots_of(rows, "own_run")), "overlap")


_CT = f"with t as (select l2 category, own_leaf cls, count(*) n, sum({W}) w from {MAIN} where l2 is not null and own_leaf is not null group by all), ct as (select *, n / sum(n) over (partition by category)::double p, w / sum(w) over (partition by category) wp from t)"


@query("crosstab_category_class", _CT + " select category, cls, n, w, round(p, 6) p, round(wp, 6) wp from ct")
def crosstab_category_class(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.crosstab(_rows(spark, d), "l2", "own_leaf", _weight()), "p", "wp")


@query("class_concentration", _CT + ", r as (select *, row_number() over (partition by cls order by n desc, category) r from ct) select cls, sum(n)::bigint n, count(*) categories, max(case when r = 1 then category end) \"first\", round(max(case when r = 1 then n end) / sum(n)::double, 6) first_share from r group by cls")
def class_concentration(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.concentration(C.crosstab(_rows(spark, d), "l2", "own_leaf", _weight())), "first_share")


_COMP = f"""
with t as (select own_leaf outer_, own_run snap, l2 inner_, count(*) n from {MAIN} where own_leaf is not null and own_run is not null and l2 is not null group by all),
c as (select *, sum(n) over (partition by outer_, snap)::double t, row_number() over (partition by outer_, snap order by n desc, inner_) r, sum(n) over (partition by outer_, snap order by n desc, inner_ rows unbounded preceding) run, 1.959964e0 z from t),
x as (select *, n / t p, run / t running from c)
"""


@query("nested_composition", _COMP + """
select outer_ "outer", snap, inner_ "inner", n, round(p, 6) p, round(greatest(0e0, (p + z*z/(2*t) - z*sqrt(p*(1-p)/t + z*z/(4*t*t)))/(1 + z*z/t)), 6) lo, round(least(1e0, (p + z*z/(2*t) + z*sqrt(p*(1-p)/t + z*z/(4*t*t)))/(1 + z*z/t)), 6) hi, r, round(running, 6) running from x""")
def nested_composition(spark: SparkSession, d: str) -> DataFrame:
    c = C.composition(_rows(spark, d), "own_leaf", "l2", "own_run")
    return r6(c.withColumn("r", F.col("r").cast("bigint")), "p", "lo", "hi", "running")


@query("composition_to_80pct", _COMP + """
select outer_ "outer", snap, count(*) inner_classes, round(exp(-sum(p*ln(p))), 6) effective, sum(case when running - p < 0.8e0 - 1e-9 then 1 else 0 end)::bigint to_mass, max(case when r = 1 then inner_ end) "first" from x group by outer_, snap""")
def composition_to_80pct(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.structure(C.composition(_rows(spark, d), "own_leaf", "l2", "own_run")), "effective")


@query("weighted_gini", f"""
with t as (select own_run grp, {W} x from {MAIN}), s as (select *, row_number() over (partition by grp order by x) i from t where x > 0)
select grp, count(*) n, round(2*sum(i*x) / (count(*)*sum(x)) - (count(*) + 1) / count(*)::double, 6) gini from s group by grp""")
def weighted_gini(spark: SparkSession, d: str) -> DataFrame:
    return r6(C.gini(_rows(spark, d), "own_run", _weight()), "gini")


@query("head_concentration_topn", f"""
with s as (select own_run snap, core "key", count(*) n, sum({W}) w from {MAIN} where core is not null and own_run is not null group by all),
r as (select *, row_number() over (partition by snap order by n desc, "key") r from s)
select snap, sum(n)::bigint "rows", count(*) keys,
 {", ".join(f"round(sum(case when r <= {k} then n else 0 end) / sum(n)::double, 6) rows_top{k}, round(sum(case when r <= {k} then w else 0 end) / sum(w), 6) weight_top{k}" for k in (1, 3, 5, 10))},
 round(sum(n)::double * sum(n) / sum(n*n), 6) effective from r group by snap""")
def head_concentration_topn(spark: SparkSession, d: str) -> DataFrame:
    h = C.head(_rows(spark, d), "core", "own_run", _weight())
    return r6(h, *[c for c in h.columns if "top" in c or c == "effective"])
