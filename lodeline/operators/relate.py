"""Joins and set operations beyond plain equality: containment, change of names, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wrapped(long_: DataFrame, heads: DataFrame, text: str, head: str, keep: list[str], least: int = 3, more: int = 2) -> DataFrame:
    """``keep``, head: the longest head text contained in a longer text.

    Every substring of a text meets the heads in an equality join, so no text is compared with all heads; heads
    have at least ``least`` characters and no head of digits alone counts. Ties go to the smaller text.
    """
    h = heads.where((F.length(head) >= least) & ~F.col(head).rlike("^[0-9]+$")).select(F.col(head).alias("head")).distinct()
    n = F.length("_t")
    # an inverted start: only substrings that begin where some head begins, and of the length of one that begins so, can match
    starts = h.select(F.substring("head", 1, least).alias("_s"), F.length("head").alias("_k")).distinct()
    t = long_.select(*keep, F.col(text).alias("_t")).where(n >= least + more)
    at = t.select(*keep, "_t", F.explode(F.sequence(F.lit(1), n - least + 1)).alias("_i")).withColumn("_s", F.substring("_t", F.col("_i"), F.lit(least)))
    fits = (F.col("_i") + F.col("_k") - 1 <= n) & (n >= F.col("_k") + more)
    cand = at.join(starts, "_s").where(fits).select(*keep, F.substring("_t", F.col("_i"), F.col("_k")).alias("head"))
    best = cand.join(h, "head").groupBy(*keep).agg(F.max(F.struct(F.length("head"), F.col("head"))).alias("_b"))
    return best.select(*keep, F.col("_b.head").alias("head"))


def diff_by_name(previous: DataFrame, current: DataFrame, name: str, size: str, least: float = 0.005) -> DataFrame:
    """Baseline difference by name: appeared, vanished, grown, shrunk (share moved by ``least``) or same."""
    share = lambda d, a: d.select(name, (F.col(size) / F.sum(size).over(Window.partitionBy())).alias(a))  # noqa: E731 - one row a class
    j = share(previous, "before").join(share(current, "after"), name, "full_outer")
    d = F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    return j.withColumn("change", F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "vanished").when(d >= least, "grown").when(d <= -least, "shrunk").otherwise("same"))


def coverage_report(expected: DataFrame, found: DataFrame, unique: str) -> DataFrame:
    """Ids that are missing or unexpected."""
    e, f = expected.select(unique, F.lit(True).alias("_e")), found.select(unique, F.lit(True).alias("_f"))
    j = e.join(f, unique, "full_outer")
    return j.where("_e is null or _f is null").select(unique, F.when(F.col("_f").isNull(), "missing").otherwise("unexpected").alias("problem"))


def indistinguishable(df: DataFrame, leaf: str, family: str, name: str) -> DataFrame:
    """Leaves of one family that share a name, with their rows."""
    c = df.where(F.col(leaf).isNotNull()).groupBy(F.col(family).alias("family"), F.col(name).alias("name"), F.col(leaf).alias("leaf")).agg(F.count("*").alias("n"))
    return c.withColumn("leaves", F.count("*").over(Window.partitionBy("family", "name"))).where("leaves > 1")
