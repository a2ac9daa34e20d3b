"""Queries of sparse features, classifiers, confidence, examples and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import positive
from ..operators import model as M
from ..session import table
from .queries import MAIN, query, r6

W = "case when pv > 0 and not isnan(pv) then pv end"


@query("tfidf_part_names", """
with g as (select p_partkey, substring(lower(p_name), j::int, k::int) term from part, unnest([1, 2, 3]) a(k), unnest(generate_series(1, length(p_name) - k + 1)) b(j) where length(p_name) >= k),
tf as (select p_partkey, term, count(*) tf from g group by all), n as (select count(*) n from part where p_name is not null), d as (select term, ln((1 + max(n.n)) / (1 + count(*))::double) + 1 idf from tf, n group by term having count(*) >= 2),
t as (select p_partkey, term, (1 + ln(tf)) * idf w from tf join d using (term)), l as (select p_partkey, sqrt(sum(w*w)) l from t group by 1) select p_partkey, term, round(w / l, 6) weight from t join l using (p_partkey)""")
def tfidf_part_names(spark: SparkSession, d: str) -> DataFrame:
    return r6(M.tfidf(table(spark, d, "part"), "p_partkey", "p_name"), "weight")


@query("class_confidence", f"""
with t as (select own_leaf cls, own_run snap, count(*) n, avg(sim) c, avg((sim < 0.6)::int) a from {MAIN} where own_leaf is not null and own_run is not null and sim is not null and not isnan(sim) group by all)
select cls, snap, n, round(c, 6) confidence, round(a, 6) ambiguous, first_value(case when n >= 20 then snap end ignore nulls) over (partition by cls order by case when n >= 20 then c end asc nulls last, snap rows between unbounded preceding and unbounded following) lowest,
 round(max(c) over (partition by cls) - min(c) over (partition by cls), 6) "range" from t""")
def class_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, MAIN).withColumn("amb", F.col("sim") < 0.6)
    return r6(M.class_confidence(m, "own_leaf", "own_run", "sim", "amb"), "confidence", "ambiguous", "range")


@query("quotable_examples_top", f"""
with r as (select own_leaf cls, own_run snap, row_id id, row_number() over (partition by own_leaf, own_run order by coalesce({W}, 0) desc, row_id) place from {MAIN} where own_leaf is not null and own_run is not null and not regexp_matches(query, '@|[0-9]{{6}}'))
select cls, snap, 'top' kind, place, id from r where place <= 3""")
def quotable_examples_top(spark: SparkSession, d: str) -> DataFrame:
    """The first rows by weight; the random ones are in quotable_examples_random."""
    e = M.examples(table(spark, d, MAIN), "own_leaf", "own_run", "row_id", positive(F.col("pv")), ~F.col("query").rlike("@|[0-9]{6}"))
    return e.where("kind = 'top'")


@query("quotable_examples_random", f"""
with r as (select own_leaf cls, own_run snap, row_id id, row_number() over (partition by own_leaf, own_run order by coalesce({W}, 0) desc, row_id) t from {MAIN} where own_leaf is not null and own_run is not null and not regexp_matches(query, '@|[0-9]{{6}}')),
x as (select *, row_number() over (partition by cls, snap order by md5('0:' || id), id) place from r where t > 3) select cls, snap, 'random' kind, place, id from x where place <= 3""")
def quotable_examples_random(spark: SparkSession, d: str) -> DataFrame:
    e = M.examples(table(spark, d, MAIN), "own_leaf", "own_run", "row_id", positive(F.col("pv")), ~F.col("query").rlike("@|[0-9]{6}"))
    return e.where("kind = 'random'")


@query("weighted_median_length", f"""
with t as (select own_run grp, length(query) x, sum({W}) w from {MAIN} where query is not null and {W} is not null group by all), r as (select *, sum(w) over (partition by grp order by x rows unbounded preceding) run, sum(w) over (partition by grp) a from t)
select grp, min(x) quantile from r where run >= 0.5 * a group by grp""")
def weighted_median_length(spark: SparkSession, d: str) -> DataFrame:
    return M.weighted_quantile(table(spark, d, MAIN), "own_run", F.length("query").cast("bigint"), positive(F.col("pv")), 0.5)


@query("snapshot_manifest", f"select own_run snap, count(*) n, count({W}) weighted, coalesce(min({W}) = max({W}), true) uniform, 'stratum' axis from {MAIN} group by own_run")
def snapshot_manifest(spark: SparkSession, d: str) -> DataFrame:
    return M.manifest(table(spark, d, MAIN), "own_run", F.col("pv"), "stratum")


@query("bootstrap_weight_share")
def bootstrap_weight_share(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, MAIN).select("row_id", "own_run", "own_leaf", "pv")
    return M.bootstrap_share(m, "own_run", F.col("own_leaf") == "mock tests", positive(F.col("pv")))


@query("classifier_out_of_fold")
def classifier_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    best, _ = M.cross_validated(table(spark, d, "embeddings"), "embedding", "label", "vec_id")
    return best


@query("classifier_report")
def classifier_report(spark: SparkSession, d: str) -> DataFrame:
    best, _ = M.cross_validated(table(spark, d, "embeddings"), "embedding", "label", "vec_id")
    return M.class_report(best)
