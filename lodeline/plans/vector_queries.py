"""Queries of the vector and clustering operators over the labelled embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import vectors as V
from ..session import table
from .queries import query, r6

_C = """with u as (select vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) v from embeddings),
p as (select label, i, sum(v[i]) x, count(*) n from u, unnest(generate_series(1, 64)) g(i) group by label, i), s as (select label, max(n) n, list(x order by i) s from p group by label),
c as (select label, n, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) c, s from s)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query("centroids", _C + " select label, n, round(c[1], 6) first_value, round(sqrt(list_dot_product(s, s)) / n, 6) resultant from c")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    s = V.sums(_rows(spark, d), "label", "embedding")
    return r6(s.select("label", "n", V.unit(F.col("s"))[0].alias("first_value"), (V.norm(F.col("s")) / F.col("n")).alias("resultant")), "first_value", "resultant")


@query("centroid_assign_margin", _C + """, a as (select vec_id, c.label, list_dot_product(v, c.c) d, row_number() over (partition by vec_id order by list_dot_product(v, c.c) desc, c.label) r from u, c)
select x.vec_id, x.label assigned, round(x.d, 6) similarity, y.label runner_up, round(x.d - y.d, 6) margin, x.d - y.d < 0.02 ambiguous from a x join a y on x.vec_id = y.vec_id and x.r = 1 and y.r = 2""")
def centroid_assign_margin(spark: SparkSession, d: str) -> DataFrame:
    e = _rows(spark, d)
    return r6(V.assign(e, "embedding", V.centroids(e, "label", "embedding"), ["vec_id"]), "similarity", "margin")


@query("ambiguous_route", _C + """, a as (select vec_id, list_dot_product(v, c.c) d, row_number() over (partition by vec_id order by list_dot_product(v, c.c) desc, c.label) r from u, c)
select count(*) n, sum((x.d - y.d < 0.02)::int)::bigint fallback, round(avg((x.d - y.d < 0.02)::int), 6) rate from a x join a y on x.vec_id = y.vec_id and x.r = 1 and y.r = 2""")
def ambiguous_route(spark: SparkSession, d: str) -> DataFrame:
    e = _rows(spark, d)
    a = V.assign(e, "embedding", V.centroids(e, "label", "embedding"), ["vec_id"])
    return r6(a.agg(F.count("*").alias("n"), F.sum(F.col("ambiguous").cast("long")).alias("fallback"), F.avg(F.col("ambiguous").cast("int")).alias("rate")), "rate")


@query("centroid_similarity_pairs", _C + " select a.label label_a, b.label label_b, round(list_dot_product(a.c, b.c), 6) cosine from c a join c b on a.label < b.label where list_dot_product(a.c, b.c) >= -1 order by list_dot_product(a.c, b.c) desc limit 40")
def centroid_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return r6(V.centroid_pairs(V.centroids(_rows(spark, d), "label", "embedding"), -1.0), "cosine")


@query("group_cohesion", _C + """, a as (select list(x order by i) s, max(n) n from (select i, sum(x) x, sum(n) n from p group by i)), b as (select (list_dot_product(s, s) - n) / (n::double*(n-1)) baseline from a)
select label grp, n, round((list_dot_product(s, s) - n) / (n::double*(n-1)), 6) cohesion, n < 10 too_small, round(baseline, 6) baseline, round((list_dot_product(s, s) - n) / (n::double*(n-1)) / baseline, 4) lift,
 case when n < 10 then 'too small' when (list_dot_product(s, s) - n) / (n::double*(n-1)) / baseline >= 1.35 then 'trusted' else 'not trusted' end verdict from c, b""")
def group_cohesion(spark: SparkSession, d: str) -> DataFrame:
    t = V.cohesion_lift(_rows(spark, d), "label", "embedding")
    return r6(t, "cohesion", "baseline").withColumn("lift", F.round("lift", 4))


@query("cosine_silhouette", _C + """, x as (select u.vec_id, u.label, c.label cl, c.n, case when u.label = c.label then (c.n - list_dot_product(v, c.s)) / greatest(c.n - 1, 1) else 1 - list_dot_product(v, c.s) / c.n end d from u, c),
y as (select vec_id, min(case when cl = label then d end) a, min(case when cl <> label then d end) b from x group by vec_id) select vec_id, round((b - a) / greatest(a, b), 6) silhouette from y""")
def cosine_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return r6(V.silhouette(_rows(spark, d), "label", "embedding", ["vec_id"]), "silhouette")


_NN = """with u as (select vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) v from embeddings),
h as (select a.vec_id query_id, b.vec_id id, b.label <> a.label other, round(list_dot_product(a.v, b.v), 6) cosine, row_number() over (partition by a.vec_id order by round(list_dot_product(a.v, b.v), 6) desc, b.vec_id) place from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)"""


@query("nearest_to_queries", _NN + " select query_id, id, cosine, place from h where place <= 5")
def nearest_to_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, searched in all rows."""
    e = _rows(spark, d)
    return V.nearest(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), 5)


@query("knn_label_scan", _NN + " select query_id, count(*) n, round(avg(other::int), 6) disagreement, avg(other::int) >= 0.8 flagged from h where place <= 10 group by query_id")
def knn_label_scan(spark: SparkSession, d: str) -> DataFrame:
    e = _rows(spark, d)
    return r6(V.knn_label_scan(e, "vec_id", "embedding", "label", e.where("vec_id % 20 = 0")), "disagreement")


@query("novelty_sentinel", _C + """, a as (select vec_id, c.label, list_dot_product(v, c.c) d, row_number() over (partition by vec_id order by list_dot_product(v, c.c) desc, c.label) r from u, c), b as (select quantile_cont(d, 0.01) b from a where r = 1)
select vec_id, label assigned, round(d, 6) similarity from a, b where r = 1 and d <= b""")
def novelty_sentinel(spark: SparkSession, d: str) -> DataFrame:
    e = _rows(spark, d)
    return r6(V.novelty(e, "embedding", V.centroids(e, "label", "embedding"), ["vec_id"]), "similarity")


@query("hashing_encoder", """
with g as (select p_partkey, substring(p_name, j::int, k::int) gram from part, unnest([1, 2, 3]) a(k), unnest(generate_series(1, length(p_name) - k + 1)) b(j)),
h as (select p_partkey, ('0x' || substring(md5('0:' || gram), 1, 8))::bigint h from g), v as (select p_partkey, h % 256 i, sum(case when h % 2 = 1 then 1 else -1 end)::double s from h group by 1, 2), n as (select p_partkey, sqrt(sum(s*s)) n from v group by 1)
select p_partkey, i, round(s / n, 6) x from v join n using (p_partkey) where s <> 0""")
def hashing_encoder(spark: SparkSession, d: str) -> DataFrame:
    e = V.hashing_encoder(table(spark, d, "part").select("p_partkey", "p_name"), "p_name")
    t = e.select("p_partkey", F.posexplode("encoding").alias("i", "x")).where("x <> 0")
    return r6(t.withColumn("i", F.col("i").cast("bigint")), "x")


@query("heldout_reproduction")
def heldout_reproduction(spark: SparkSession, d: str) -> DataFrame:
    return V.heldout(_rows(spark, d), "label", "embedding", "vec_id")


@query("active_learning_batch")
def active_learning_batch(spark: SparkSession, d: str) -> DataFrame:
    e = _rows(spark, d)
    return V.active_learning_batch(V.assign(e, "embedding", V.centroids(e, "label", "embedding"), ["vec_id"]), "vec_id", 100)


@query("kmeans_sweep")
def kmeans_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = K.sweep(_rows(spark, d), "embedding", "vec_id", [5, 10], "label")
    return spark.createDataFrame([(r["k"], r["stability"], r["silhouette"], r["ami"], r["purity"]) for r in rows], "k int, stability double, silhouette double, ami double, purity double")


@query("algorithm_battery")
def algorithm_battery(spark: SparkSession, d: str) -> DataFrame:
    rows = K.algorithm_battery(_rows(spark, d), "embedding", "vec_id", [15, 20, 30])
    return spark.createDataFrame([(r["algorithm"], r["k"], r["stability"]) for r in rows], "algorithm string, k int, stability double")


@query("two_level_tree")
def two_level_tree(spark: SparkSession, d: str) -> DataFrame:
    return K.two_level(_rows(spark, d), "embedding", "vec_id", 4, min_leaf=30).select("vec_id", "family", "leaf")


@query("refined_partition")
def refined_partition(spark: SparkSession, d: str) -> DataFrame:
    return K.refine(_rows(spark, d), "embedding", "vec_id", "label").select("vec_id", "label")


@query("partition_stability")
def partition_stability(spark: SparkSession, d: str) -> DataFrame:
    v = K.partition_stability(_rows(spark, d), "embedding", "vec_id", "label")
    return spark.createDataFrame(list(enumerate(v)), "split int, ari double")


@query("cluster_purity", """
with c as (select own_leaf, upper(trim(u_ds)) u, count(*) n from sva_dom_edu_wraps_head where own_leaf is not null and u_ds is not null group by all), m as (select u, max(n) m, sum(n) t from c group by u) select sum(t)::bigint n, round(sum(m) / sum(t)::double, 6) purity from m""")
def cluster_purity(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sva_dom_edu_wraps_head").select("own_leaf", F.upper(F.trim("u_ds")).alias("u"))
    return r6(V.purity(t, "own_leaf", "u"), "purity")
