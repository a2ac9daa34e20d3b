"""Queries of the label, rule, sampling and serving operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import sampling as P
from ..session import table
from .queries import MAIN, query, r6

_RULES = [L.Rule("r1", "音频|audio", "U07"), L.Rule("r2", "翻译|translat", "U06"), L.Rule("r3", "模拟|mock test", "U11"), L.Rule("r4", "download|下载", "U07"), L.Rule("r5", "好累|tired", "U12"), L.Rule("r6", "答案|answer", "U04")]


def _kappa_sql(a: str, b: str, source: str) -> str:
    return f"""
with t as (select {a} a, {b} b from {source} where {a} is not null and {b} is not null), n as (select count(*)::double n, sum((a = b)::int)::double k from t),
e as (select sum(x.c::double * y.c) e from (select a, count(*) c from t group by a) x join (select b, count(*) c from t group by b) y on x.a = y.b)
select n::bigint n, round(k / n, 6) agreement, round((k / n - e / (n*n)) / (1 - e / (n*n)), 6) kappa from n, e"""


@query("annotator_kappa_gold", _kappa_sql("label_a", "label_b", "gold_rows"))
def annotator_kappa_gold(spark: SparkSession, d: str) -> DataFrame:
    return r6(L.kappa(table(spark, d, "gold_rows"), "label_a", "label_b"), "agreement", "kappa")


@query("labeller_kappa", _kappa_sql("u_ds", "u_qw", MAIN))
def labeller_kappa(spark: SparkSession, d: str) -> DataFrame:
    return r6(L.kappa(table(spark, d, MAIN), "u_ds", "u_qw"), "agreement", "kappa")


@query("fleiss_kappa_votes", """
with c as (select row_id item, u_code cat, count(*) n from edu_label_votes where row_id is not null and u_code is not null group by all),
i as (select item, sum(n) m, sum(n*(n-1)) pairs from c group by item having sum(n) > 1), md as (select m from i group by m order by count(*) desc, m desc limit 1),
ch as (select i.* from i join md using (m)), p as (select count(*) items, max(m) m, avg(pairs / (m*(m-1))::double) po from ch),
e as (select sum(n::double*n) / (sum(n)::double*sum(n)) pe from (select cat, sum(c.n) n from c join ch using (item) group by cat))
select items, m::bigint ratings, round(po, 6) po, round(pe, 6) pe, round((po - pe) / (1 - pe), 6) kappa from p, e""")
def fleiss_kappa_votes(spark: SparkSession, d: str) -> DataFrame:
    return r6(L.fleiss(table(spark, d, "edu_label_votes"), "row_id", "u_code"), "po", "pe", "kappa")


@query("referee_balance", """
with d as (select * from gold_rows where label_a is not null and label_b is not null and final_label is not null and label_a <> label_b),
s as (select sum((final_label = label_a)::int)::bigint a_wins, sum((final_label = label_b)::int)::bigint b_wins, sum((final_label <> label_a and final_label <> label_b)::int)::bigint neither from d)
select *, round((a_wins - b_wins) / sqrt(a_wins + b_wins), 6) z, case when a_wins + b_wins < 20 then 'undecidable' when abs((a_wins - b_wins) / sqrt(a_wins + b_wins)) > 3 then 'lopsided' else 'balanced' end verdict from s""")
def referee_balance(spark: SparkSession, d: str) -> DataFrame:
    return r6(L.annotator_balance(table(spark, d, "gold_rows"), "label_a", "label_b", "final_label"), "z")


@query("contested_pairs", """
select least(label_a, label_b) class_a, greatest(label_a, label_b) class_b, count(*) n, count(distinct final_label) finals from gold_rows where label_a <> label_b and final_label is not null group by 1, 2 having count(distinct final_label) > 1""")
def contested_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.contested(table(spark, d, "gold_rows"), "label_a", "label_b", "final_label")


@query("boundary_evidence", """
with d as (select least(label_a, label_b) a, greatest(label_a, label_b) b, final_label v from gold_rows where label_a <> label_b and (final_label = label_a or final_label = label_b)),
c as (select a, b, v, count(*) n from d group by all), t as (select *, sum(n) over (partition by a, b)::double t, row_number() over (partition by a, b order by n desc, v) r from c), x as (select *, n / t p, 1.959964e0 z from t where r = 1 and t >= 2)
select a class_a, b class_b, t::bigint n, v majority, round(p, 6) share, round(greatest(0e0, (p + z*z/(2*t) - z*sqrt(p*(1-p)/t + z*z/(4*t*t)))/(1 + z*z/t)), 6) lo, round(least(1e0, (p + z*z/(2*t) + z*sqrt(p*(1-p)/t + z*z/(4*t*t)))/(1 + z*z/t)), 6) hi,
 (p + z*z/(2*t) - z*sqrt(p*(1-p)/t + z*z/(4*t*t)))/(1 + z*z/t) > 0.5 decisive from x""")
def boundary_evidence(spark: SparkSession, d: str) -> DataFrame:
    return r6(L.rules_against_evidence(table(spark, d, "gold_rows"), "label_a", "label_b", "final_label", least=2), "share", "lo", "hi")


@query("stated_grounds", "select least(label_a, label_b) class_a, greatest(label_a, label_b) class_b, coalesce(contains(query, '怎么'), false) with_marker, count(*) n, count(distinct final_label) verdicts from gold_rows where label_a <> label_b and final_label is not null group by 1, 2, 3")
def stated_grounds(spark: SparkSession, d: str) -> DataFrame:
    return L.stated_grounds(table(spark, d, "gold_rows"), "query", "label_a", "label_b", "final_label", "怎么")


@query("gold_assembled", """
with g as (select idx, case when regexp_matches(label_a, '^U(0[1-9]|1[0-3])$') then label_a else 'UNLABELED' end a, case when regexp_matches(label_b, '^U(0[1-9]|1[0-3])$') then label_b else 'UNLABELED' end b, final_label f from gold_rows)
select idx, case when a = 'UNLABELED' or b = 'UNLABELED' then 'missing' when a = b then 'agreed' else 'disagreement' end status, case when a = 'UNLABELED' or b = 'UNLABELED' then null when a = b then a when regexp_matches(f, '^U(0[1-9]|1[0-3])$') then f end gold from g""")
def gold_assembled(spark: SparkSession, d: str) -> DataFrame:
    codes = [f"U{i:02d}" for i in range(1, 14)]
    return L.assemble_gold(table(spark, d, "gold_rows"), "label_a", "label_b", "final_label", codes).select("idx", "status", "gold")


@query("rule_precision", "with g as (select query, final_label l from gold_rows where final_label is not null) " + " union all ".join(f"""
select '{r.id}' "rule", '{r.label}' label, coalesce(sum(h), 0)::bigint hits, coalesce(sum(case when l = '{r.label}' then h else 0 end), 0)::bigint "right", round(sum(case when l = '{r.label}' then h else 0 end) / nullif(sum(h), 0)::double, 6) "precision", coalesce(sum(case when l = '{r.label}' then h else 0 end) / nullif(sum(h), 0)::double >= 0.98, false) accepted from (select l, coalesce(regexp_matches(query, '{r.pattern}'), false)::int h from g)""" for r in _RULES))
def rule_precision(spark: SparkSession, d: str) -> DataFrame:
    return r6(L.validate_rules(table(spark, d, "gold_rows"), "query", "final_label", _RULES), "precision")


@query("first_match_rule_labels", "select row_id, case " + " ".join(f"when regexp_matches(query, '{r.pattern}') then '{r.id}'" for r in _RULES) + " end \"rule\", case " + " ".join(f"when regexp_matches(query, '{r.pattern}') then '{r.label}'" for r in _RULES) + f" end rule_label from {MAIN}")
def first_match_rule_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.apply_rules(table(spark, d, MAIN).select("row_id", "query"), "query", _RULES).select("row_id", "rule", "rule_label")


@query("rule_feature_matrix", "select row_id, " + ", ".join(f"coalesce(regexp_matches(query, '{r.pattern}'), false) rule_{r.id}" for r in _RULES) + f" from {MAIN}")
def rule_feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return L.rule_matrix(table(spark, d, MAIN), "query", _RULES, ["row_id"])


_WIDE = [*_RULES, L.Rule("r7", "的", "U01"), L.Rule("r8", "the ", "U02")]


@query("rule_conflicts", "with h as (" + " union all ".join(f"select row_id, '{r.id}' i, '{r.label}' l, {k} o from {MAIN} where regexp_matches(query, '{r.pattern}')" for k, r in enumerate(_WIDE)) + """),
n as (select i, count(*) n from h group by i), p as (select a.i rule_a, b.i rule_b, count(*) n_both from h a join h b on a.row_id = b.row_id and a.o < b.o where a.l <> b.l group by all having count(*) >= 25)
select rule_a, rule_b, n_both, round(n_both / (x.n + y.n - n_both)::double, 6) jaccard from p join n x on x.i = rule_a join n y on y.i = rule_b""")
def rule_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return r6(L.rule_conflicts(table(spark, d, MAIN), "query", _WIDE), "jaccard")


@query("ece_bins", f"""
with t as (select greatest(1, least(10, ceil(sim * 10)::int)) bin, sim c, (upper(trim(u_ds)) = upper(trim(u_nn)))::int ok from {MAIN} where sim is not null and not isnan(sim) and u_ds is not null and u_nn is not null)
, g as (select bin, count(*) n, avg(c) confidence, avg(ok) accuracy from t group by bin)
select bin, n, round(confidence, 6) confidence, round(accuracy, 6) accuracy, round(abs(confidence - accuracy) * n / sum(n) over (), 6) part from g""")
def ece_bins(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, MAIN).where("u_ds is not null and u_nn is not null").withColumn("ok", F.upper(F.trim("u_ds")) == F.upper(F.trim("u_nn")))
    return r6(L.ece(t, "sim", "ok"), "confidence", "accuracy", "part")


@query("ece_noise_floor")
def ece_noise_floor(spark: SparkSession, d: str) -> DataFrame:
    return L.ece_noise_floor(table(spark, d, MAIN).where("sim between 0 and 1").select("row_id", "sim"), "sim")


@query("label_disagreements", f"select row_id, u_ds, u_qw from {MAIN} where u_ds is distinct from u_qw")
def label_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return L.disagreements(table(spark, d, MAIN).select("row_id", "u_ds", "u_qw"), "u_ds", "u_qw")


@query("promoted_labels", f"select row_id, u_ds u_ds_v1, coalesce(u_qw, u_ds) label_final, case when u_qw is not null and u_qw is distinct from u_ds then 'challenger' else 'incumbent' end label_source from {MAIN}")
def promoted_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.promote(table(spark, d, MAIN).select("row_id", "u_ds", "u_qw"), "u_ds", "u_qw", True).select("row_id", "u_ds_v1", "label_final", "label_source")


@query("unified_class_codes", f"select row_id, coalesce(c.u_code, 'U13') u_code from {MAIN} m left join edu_crosswalk c on upper(trim(m.own_code)) = c.own_code")
def unified_class_codes(spark: SparkSession, d: str) -> DataFrame:
    """A run's class code as a unified one; unknown codes are fragments."""
    c = table(spark, d, "edu_crosswalk")
    m = table(spark, d, MAIN).select("row_id", F.upper(F.trim("own_code")).alias("own_code"))
    return m.join(F.broadcast(c.select("own_code", "u_code")), "own_code", "left").select("row_id", F.coalesce("u_code", F.lit("U13")).alias("u_code"))


@query("proportion_gates", f"""
with t as (select own_run, count(*)::double n, sum((upper(trim(u_ds)) = upper(trim(u_qw)))::int)::double k, 1.96e0 z from {MAIN} where u_ds is not null and u_qw is not null group by own_run), x as (select *, k/n p from t)
select own_run, n::bigint n, round(p, 6) observed, case when (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n)))/(1 + z*z/n) >= 0.5 then 'met' when (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n)))/(1 + z*z/n) < 0.5 then 'missed' else 'underpowered' end gate, ceil(z*z*p*(1-p) / ((p-0.5)*(p-0.5)))::bigint n_needed from x""")
def proportion_gates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, MAIN).where("u_ds is not null and u_qw is not null").groupBy("own_run").agg(F.count("*").alias("n"), F.sum((F.upper(F.trim("u_ds")) == F.upper(F.trim("u_qw"))).cast("long")).alias("k"))
    p = F.col("k") / F.col("n")
    return r6(t.select("own_run", "n", p.alias("observed"), L.proportion_gate(F.col("k"), F.col("n"), 0.5).alias("gate"), L.required_n(p, 0.5).cast("bigint").alias("n_needed")), "observed")


@query("route_agreement")
def route_agreement(spark: SparkSession, d: str) -> DataFrame:
    """ARI, NMI, AMI and purity of two labelings of the query table."""
    return L.score_partition(table(spark, d, MAIN).select("own_leaf", F.upper(F.trim("u_ds")).alias("u")), "own_leaf", "u")


@query("stratified_sample")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.stratified(table(spark, d, MAIN).select("row_id", "own_leaf"), 400, "own_leaf", "row_id")


@query("deterministic_subsample", f"select row_id, query from {MAIN} order by md5('0:' || row_id), row_id limit 300")
def deterministic_subsample(spark: SparkSession, d: str) -> DataFrame:
    return P.subsample(table(spark, d, MAIN).select("row_id", "query"), 300, "row_id")


@query("blind_matchups", f"select row_id, query, case when md5('0:' || row_id) < '8' then u_ds else u_qw end side_a, case when md5('0:' || row_id) < '8' then u_qw else u_ds end side_b from {MAIN} where u_ds is distinct from u_qw")
def blind_matchups(spark: SparkSession, d: str) -> DataFrame:
    pairs, _ = P.blind_matchups(table(spark, d, MAIN), "row_id", "query", "u_ds", "u_qw")
    return pairs


@query("random_rows_per_cluster", f"with r as (select row_id, own_leaf, query, row_number() over (partition by own_leaf order by md5('0:' || row_id), row_id) place from {MAIN} where own_leaf is not null) select * from r where place <= 12")
def random_rows_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return P.per_group(table(spark, d, MAIN).select("row_id", "own_leaf", "query"), "own_leaf", 12, "row_id")


@query("middle_exemplars", f"with r as (select own_leaf grp, row_id exemplar, row_number() over (partition by own_leaf order by row_id) r, count(*) over (partition by own_leaf) n from {MAIN} where own_leaf is not null) select grp, exemplar, n from r where r = n // 2 + 1")
def middle_exemplars(spark: SparkSession, d: str) -> DataFrame:
    return P.middle_exemplar(table(spark, d, MAIN), "own_leaf", "row_id")


@query("representative_cover", f"""
with b as (select own_leaf cell, l2 stratum, row_id, coalesce(case when not isnan(sim) then sim end, 0) s from {MAIN} where own_leaf is not null and l2 is not null),
r as (select *, row_number() over (partition by cell, stratum order by s desc, row_id) c from b), g as (select cell, stratum, count(*) n, max(case when c = 1 then row_id end) id from r group by all),
o as (select *, sum(n) over (partition by cell) t, sum(n) over (partition by cell order by n desc, stratum rows unbounded preceding) - n before, row_number() over (partition by cell order by n desc, stratum) place from g)
select cell, stratum, n, id, place from o where before < 0.8e0 * t and place <= 8""")
def representative_cover(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, MAIN).where("own_leaf is not null and l2 is not null").withColumn("s", F.coalesce(F.when(~F.isnan("sim"), F.col("sim")), F.lit(0.0)))
    return P.select_cover(t, "own_leaf", "l2", "row_id", "s")


@query("shaped_read", "select o_orderkey, o_totalprice from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice > 100000 order by o_totalprice desc, o_totalprice::varchar desc limit 50")
def shaped_read(spark: SparkSession, d: str) -> DataFrame:
    out, _ = P.shape(table(spark, d, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_totalprice": ">100000"}, ["o_orderkey", "o_totalprice"], "o_totalprice", True, 50)
    return out
