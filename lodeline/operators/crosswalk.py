"""Two labelings beside each other, facets, minorities and heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S


def crosswalk(df: DataFrame, family: str, intent: str) -> DataFrame:
    """Per family: rows, its dominant intent and share, effective intents, and a verdict (one to one from 0.8, mostly from 0.5)."""
    c = df.where(F.col(family).isNotNull() & F.col(intent).isNotNull()).groupBy(F.col(family).alias("family"), F.col(intent).alias("intent")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("family")
    c = c.withColumn("t", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), F.col("intent").asc())))
    g = c.groupBy("family").agg(F.max("t").alias("n"), F.max(F.when(F.col("r") == 1, F.col("intent"))).alias("dominant"), F.max(F.when(F.col("r") == 1, F.col("n") / F.col("t"))).alias("share"), F.exp(S.entropy(F.col("n") / F.col("t"))).alias("effective"))
    return g.withColumn("verdict", F.when(F.col("share") >= 0.8, "one to one").when(F.col("share") >= 0.5, "mostly").otherwise("mixed"))


def facet_shares(df: DataFrame, cls: str, snap: str, text: str, facets: dict[str, str]) -> DataFrame:
    """Share, with interval, of each facet pattern by class and snapshot; all facets in one pass."""
    hit = {k: F.coalesce(F.col(text).rlike(p), F.lit(False)).cast("long") for k, p in facets.items()}
    t = df.where(F.col(cls).isNotNull() & F.col(snap).isNotNull()).groupBy(F.col(cls).alias("cls"), F.col(snap).alias("snap")).agg(F.count("*").alias("n"), *[F.sum(h).alias(f"_{k}") for k, h in hit.items()])
    t = t.select("cls", "snap", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(f"_{k}").alias("k")) for k in facets])).alias("x")).select("cls", "snap", "x.facet", "x.k", "n")
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return t.select("cls", "snap", "facet", "k", "n", (F.col("k") / F.col("n")).alias("p"), lo.alias("lo"), hi.alias("hi"))


def minority_dilution(df: DataFrame, label: str, kind: str, minority: str) -> DataFrame:
    """Where the rows of a minority are: share in its largest cluster, that cluster's purity, clusters touched, clusters with 5 % of them."""
    c = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.sum((F.col(kind) == minority).cast("long")).alias("k")).where("k > 0")
    t = c.withColumn("_all", F.sum("k").over(Window.partitionBy()))  # one row a cluster
    return t.agg(F.max("_all").alias("rows"), (F.max("k") / F.max("_all")).alias("in_largest"), F.max(F.struct("k", (F.col("k") / F.col("n")).alias("p"), "label")).alias("_l"), F.count("*").alias("touched"), F.sum((F.col("k") >= 0.05 * F.col("_all")).cast("long")).alias("with_5pct")).select("rows", "in_largest", F.col("_l.p").alias("purity"), "touched", "with_5pct")


def kind_profile(df: DataFrame, kind: Column, least: float = 0.005) -> DataFrame:
    """Shares of the kinds of rows; the dominant one, minorities from ``least``, traces below."""
    c = df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # one row a kind
    c = c.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("n").desc(), F.col("kind").asc())))
    return c.select("kind", "n", "share", F.when(F.col("_r") == 1, "dominant").when(F.col("share") >= least, "minority").otherwise("trace").alias("role"))


def leaves_per_family(df: DataFrame, leaf: str, family: str) -> DataFrame:
    return df.where(F.col(leaf).isNotNull() & F.col(family).isNotNull()).groupBy(F.col(family).alias("family")).agg(F.count_distinct(leaf).alias("leaves"), F.count("*").alias("n"))


def similarity_bands(df: DataFrame, similarity: str, text: str, edges: tuple[int, ...] = (6, 12, 24), low: float = 0.7) -> DataFrame:
    """Similarity by band of length: rows, median and share below ``low``."""
    n = F.length(text)
    band = F.lit(f"{edges[-1]}+")
    for e in reversed(edges):
        band = F.when(n < e, f"<{e}").otherwise(band)
    s = F.col(similarity)
    return df.where(s.isNotNull() & ~F.isnan(s) & n.isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.percentile(s, F.lit(0.5)).alias("median"), F.avg((s < low).cast("int")).alias("low_share"))


def tie_free_head(df: DataFrame, group: str, weight: Column, n: int) -> DataFrame:
    """Per group the weight of the n-th row and the size of the smallest head that holds all rows of that weight; from counts of distinct weights."""
    c = df.where(F.col(group).isNotNull() & weight.isNotNull()).groupBy(F.col(group).alias("grp"), weight.alias("w")).agg(F.count("*").alias("c"))
    o = Window.partitionBy("grp").orderBy(F.col("w").desc())
    c = c.withColumn("_run", F.sum("c").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return c.where((F.col("_run") - F.col("c")) < n).groupBy("grp").agg(F.min("w").alias("least_weight"), F.max("_run").alias("head"))


def weight_concentration(df: DataFrame, group: str, weight: Column, k: int = 10) -> DataFrame:
    """Share of the weight in the ``k`` heaviest rows of each group, ties counted by number; from counts of distinct weights."""
    c = df.where(F.col(group).isNotNull() & weight.isNotNull()).groupBy(F.col(group).alias("grp"), weight.alias("w")).agg(F.count("*").alias("c"))
    o = Window.partitionBy("grp").orderBy(F.col("w").desc())
    c = c.withColumn("_before", F.sum("c").over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    take = F.greatest(F.lit(0), F.least(F.col("c"), F.lit(k) - F.col("_before")))
    return c.groupBy("grp").agg(F.sum("c").alias("n"), (F.sum(take * F.col("w")) / F.sum(F.col("c") * F.col("w"))).alias("top_share"))


def mid_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each distinct value of a group with its mid-rank percentile."""
    c = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("grp"), F.col(value).alias("x")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("grp")
    below = F.sum("c").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    return c.select("grp", "x", ((below + F.col("c") / 2) / F.sum("c").over(w)).alias("percentile"))


def depth_control(df: DataFrame, cls: str, snap: str, weight: Column, a: str, b: str, n: int) -> DataFrame:
    """Total variation of the classes of two snapshots over all rows and over their heads of weight, so depth alone is no change."""
    rows = df.where(F.col(cls).isNotNull() & F.col(snap).isin(a, b)).select(F.col(cls).alias("cls"), F.col(snap).alias("snap"), weight.alias("w"))
    bound = tie_free_head(rows, "snap", F.col("w"), n).select(F.col("grp").alias("snap"), "least_weight")
    r = rows.join(F.broadcast(bound), "snap", "left")  # two rows
    side = lambda s, c: F.sum(((F.col("snap") == s) & c).cast("long"))
    head = F.coalesce(F.col("w") >= F.col("least_weight"), F.lit(False))
    g = r.groupBy("cls").agg(side(a, F.lit(True)).alias("a"), side(b, F.lit(True)).alias("b"), side(a, head).alias("ha"), side(b, head).alias("hb"))
    t = g.agg(*[F.sum(c).alias(f"_{c}") for c in ("a", "b", "ha", "hb")])
    j = g.join(F.broadcast(t), F.lit(True))
    tvd = lambda x, y: F.sum(F.abs(F.col(x) / F.col(f"_{x}") - F.col(y) / F.col(f"_{y}"))) / 2
    return j.agg(tvd("a", "b").alias("tvd"), tvd("ha", "hb").alias("tvd_head"))
