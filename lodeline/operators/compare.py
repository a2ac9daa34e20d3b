"""Comparison of class distributions across snapshots.

Everything rests on the complete grid (class x snapshot) of counts and weights: one
aggregation of the rows, combined before its shuffle; all that follows works on the small
grid. Snapshots are declared, so the grid is completed by exploding that list.
"""

from __future__ import annotations

import math
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..session import running_before

MIN_ROWS = 30


def grid(df: DataFrame, cls: str, snap: str, snapshots: list[str], weight: Column | None = None) -> DataFrame:
    """cls, snap, n, w, n_snap, w_snap, p, wp: zero cells included."""
    w = F.coalesce(weight if weight is not None else F.lit(1.0), F.lit(0.0))
    cells = df.where(F.col(cls).isNotNull() & F.col(snap).isin(*snapshots)).groupBy(F.col(cls).alias("cls"), F.col(snap).alias("snap")).agg(F.count("*").alias("n"), F.sum(w).alias("w"))
    keys = cells.select("cls").distinct().withColumn("snap", F.explode(F.array(*[F.lit(s) for s in snapshots])))
    full = keys.join(cells, ["cls", "snap"], "left").fillna(0, ["n"]).fillna(0.0, ["w"])
    over = Window.partitionBy("snap")  # as many rows as there are classes
    full = full.withColumn("n_snap", F.sum("n").over(over)).withColumn("w_snap", F.sum("w").over(over))
    return full.withColumn("p", S.ratio(F.col("n").cast("double"), F.col("n_snap"))).withColumn("wp", S.ratio(F.col("w"), F.col("w_snap")))


def snapshots_of(df: DataFrame, snap: str, most: int = 100) -> list[str]:
    """The snapshots of a table in order; refuses more than ``most``, which would be no snapshots."""
    found = sorted(r[0] for r in df.where(F.col(snap).isNotNull()).select(snap).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} snapshots in {snap}")
    return found


def matrix(g: DataFrame) -> DataFrame:
    """The main table: share with interval, weight share, index against the corpus, rank, presence across snapshots."""
    lo, hi = S.wilson(F.col("n"), F.col("n_snap"))
    by_class, by_snap = Window.partitionBy("cls"), Window.partitionBy("snap").orderBy(F.round(F.col("p"), 3).desc())
    out = g.withColumn("lo", lo).withColumn("hi", hi)
    # every cell knows its snapshot's size, so the corpus is the sum of one class's sizes
    corpus = F.sum("n").over(by_class) / F.sum("n_snap").over(by_class)
    out = out.withColumn("index", S.ratio(F.col("p"), corpus)).withColumn("rank", F.rank().over(by_snap))
    mean = F.avg("p").over(by_class)
    present = F.sum((F.col("n") > 0).cast("int")).over(by_class)
    return out.select(
        "cls", "snap", "n", "n_snap", "p", "lo", "hi", "wp", "index", S.ratio(F.col("p"), mean).alias("balanced_index"), "rank",
        present.alias("present_in"), (F.max("p").over(by_class) - F.min("p").over(by_class)).alias("range"), S.ratio(F.max("p").over(by_class), F.min("p").over(by_class)).alias("ratio"),
    )


def coverage(g: DataFrame) -> DataFrame:
    """Per snapshot: rows, classes seen, entropy, effective classes, HHI, share of the first 1, 3 and 5 classes."""
    w = Window.partitionBy("snap").orderBy(F.col("n").desc(), F.col("cls").asc())
    r = g.withColumn("r", F.row_number().over(w))
    top = lambda k: F.sum(F.when(F.col("r") <= k, F.col("p")).otherwise(0.0))
    return (
        r.groupBy("snap")
        .agg(F.max("n_snap").alias("n"), F.sum((F.col("n") > 0).cast("int")).cast("bigint").alias("classes"), S.entropy(F.col("p")).alias("entropy"), S.hhi(F.col("p")).alias("hhi"), top(1).alias("top1"), top(3).alias("top3"), top(5).alias("top5"))
        .withColumn("effective", F.exp("entropy"))
    )


def head(df: DataFrame, key: str, snap: str, weight: Column, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Concentration of each snapshot on its first k keys: by rows and by weight. Ties go to the smaller key."""
    sums = df.where(F.col(key).isNotNull() & F.col(snap).isNotNull()).groupBy(F.col(snap).alias("snap"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(F.coalesce(weight, F.lit(0.0))).alias("w"))
    totals = sums.groupBy("snap").agg(F.sum("n").alias("rows"), F.sum("w").alias("weight"), F.count("*").alias("keys"), F.sum(F.col("n") * F.col("n")).alias("_q"))
    # ranks are needed up to the largest k alone, so each task sends no more keys of a snapshot
    r = sums.withColumn("r", F.row_number().over(Window.partitionBy("snap").orderBy(F.col("n").desc(), F.col("key").asc()))).where(F.col("r") <= max(ks))
    agg = []
    for k in ks:
        agg += [F.sum(F.when(F.col("r") <= k, F.col("n")).otherwise(0)).alias(f"_n{k}"), F.sum(F.when(F.col("r") <= k, F.col("w")).otherwise(0.0)).alias(f"_w{k}")]
    t = totals.join(r.groupBy("snap").agg(*agg), "snap")
    cols = [c for k in ks for c in (S.ratio(F.col(f"_n{k}").cast("double"), F.col("rows")).alias(f"rows_top{k}"), S.ratio(F.col(f"_w{k}"), F.col("weight")).alias(f"weight_top{k}"))]
    return t.select("snap", "rows", "keys", *cols, S.ratio(F.col("rows").cast("double") * F.col("rows"), F.col("_q")).alias("effective"))


def inventory(df: DataFrame, snap: str, text: str, weight: Column) -> DataFrame:
    """Rows, distinct texts and weight of each snapshot."""
    return df.groupBy(F.col(snap).alias("snap")).agg(F.count("*").alias("rows"), F.count_distinct(text).alias("distinct_texts"), F.sum(F.coalesce(weight, F.lit(0.0))).alias("weight"))


def absence(g: DataFrame) -> DataFrame:
    """Each zero cell with the share elsewhere, the count expected, the chance of a zero, an upper bound and a verdict."""
    by = Window.partitionBy("cls")
    others_n, others = F.sum("n").over(by) - F.col("n"), F.sum("n_snap").over(by) - F.col("n_snap")
    r = g.withColumn("ref", S.ratio(others_n.cast("double"), others)).withColumn("densest", F.max(F.struct("p", F.col("snap"))).over(by)["snap"]).where("n = 0")
    r = r.withColumn("expected", F.col("ref") * F.col("n_snap")).withColumn("p_zero", F.pow(1 - F.col("ref"), F.col("n_snap")))
    return r.select("cls", "snap", "n_snap", "ref", "expected", "p_zero", S.one_sided_upper(F.col("n_snap")).alias("upper"), "densest", S.absence_verdict(F.col("expected"), F.col("p_zero")).alias("verdict"))


def _pairs(g: DataFrame, snapshots: list[str]) -> DataFrame:
    """The grid beside itself for every pair of snapshots in their order; the pairs are a declared, short list."""
    a = g.select("cls", *[F.col(c).alias(f"{c}_a") for c in ("snap", "n", "n_snap", "p", "wp")])
    a = a.withColumn("snap_b", F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(s), F.array(*[F.lit(t) for t in snapshots[i + 1 :]]).cast("array<string>")) for i, s in enumerate(snapshots)]))[F.col("snap_a")]))
    b = g.select("cls", *[F.col(c).alias(f"{c}_b") for c in ("snap", "n", "n_snap", "p", "wp")])
    return a.join(b, ["cls", "snap_b"])


def pairwise_change(g: DataFrame, snapshots: list[str]) -> DataFrame:
    """Every class and pair of snapshots: difference with interval, whether it is significant, and where it occurs."""
    d, lo, hi = S.newcombe(F.col("n_a"), F.col("n_snap_a"), F.col("n_b"), F.col("n_snap_b"))
    r = _pairs(g, snapshots).withColumn("d", d).withColumn("lo", lo).withColumn("hi", hi)
    where = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), "shared").when(F.col("n_a") > 0, "a only").when(F.col("n_b") > 0, "b only").otherwise("neither")
    return r.select("cls", "snap_a", "snap_b", "p_a", "p_b", "d", "lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"), where.alias("occurs"))


def pairwise_distance(g: DataFrame, snapshots: list[str]) -> DataFrame:
    """Per pair of snapshots: total variation by rows and by weight, Cramér's V, Spearman's rho of the counts, common classes among the first five."""
    p = _pairs(g, snapshots)
    pair = Window.partitionBy("snap_a", "snap_b")
    avg_rank = lambda c: F.rank().over(pair.orderBy(F.col(c).asc())) + (F.count("*").over(Window.partitionBy("snap_a", "snap_b", c)) - 1) / 2.0
    first = lambda c: F.row_number().over(pair.orderBy(F.col(c).desc(), F.col("cls").asc()))
    p = p.withColumn("ra", avg_rank("n_a")).withColumn("rb", avg_rank("n_b")).withColumn("ta", first("n_a")).withColumn("tb", first("n_b"))
    n = F.col("n_snap_a") + F.col("n_snap_b")
    row = F.col("n_a") + F.col("n_b")
    cell = lambda c, s: F.when(row > 0, (F.col(c) - row * F.col(s) / n) ** 2 / (row * F.col(s) / n)).otherwise(0.0)
    return (
        p.withColumn("chi", cell("n_a", "n_snap_a") + cell("n_b", "n_snap_b"))
        .groupBy("snap_a", "snap_b")
        .agg(
            (F.sum(F.abs(F.col("p_a") - F.col("p_b"))) / 2).alias("tvd"),
            (F.sum(F.abs(F.col("wp_a") - F.col("wp_b"))) / 2).alias("tvd_weight"),
            F.sqrt(F.sum("chi") / F.max(n)).alias("v"),
            S.ratio(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("rho"),
            F.sum(((F.col("ta") <= 5) & (F.col("tb") <= 5)).cast("int")).cast("bigint").alias("top5_common"),
            F.max(((F.col("ta") == 1) & (F.col("tb") == 1)).cast("int")).cast("boolean").alias("same_leader"),
        )
    )


def distance_bounds(counts_a: list[int], counts_b: list[int], tag: str, draws: int = 400, nulls: int = 300) -> dict[str, float | bool]:
    """Total variation of two count vectors with a bootstrap interval and the ceiling of same-source noise.

    Works on the counts of classes, never on rows. The stream of random numbers depends on ``tag`` alone.
    """
    rng = np.random.default_rng(zlib.crc32(tag.encode()))
    a, b = np.array(counts_a, np.int64), np.array(counts_b, np.int64)

    def tvd(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 0.5 * np.abs(x / np.maximum(1, x.sum(-1, keepdims=True)) - y / np.maximum(1, y.sum(-1, keepdims=True))).sum(-1)

    def draw(weights: np.ndarray, n: int, times: int) -> np.ndarray:
        return rng.multinomial(n, weights / max(1, weights.sum()), times) if weights.sum() else np.zeros((times, len(weights)), np.int64)

    point = float(tvd(a, b))
    boot = np.sort(tvd(draw(a, a.sum(), draws), draw(b, b.sum(), draws)))
    null = np.sort(tvd(draw(a + b, a.sum(), nulls), draw(a + b, b.sum(), nulls)))
    lo, hi, ceiling = (float(x) for x in (boot[int(0.025 * (draws - 1))], boot[int(0.975 * (draws - 1))], null[int(0.95 * (nulls - 1))]))
    return {"tvd": point, "lo": lo, "hi": hi, "ceiling": ceiling, "exceeds_noise": lo > ceiling}


def signature(g: DataFrame, snapshots: list[str]) -> DataFrame:
    """Classes significantly above (or below) every other snapshot, with the weakest end of the differences."""
    a = g.select("cls", "snap", "n", "n_snap", "p")
    b = g.select("cls", F.col("snap").alias("other"), F.col("n").alias("n_o"), F.col("n_snap").alias("n_snap_o"))
    d, lo, hi = S.newcombe(F.col("n_o"), F.col("n_snap_o"), F.col("n"), F.col("n_snap"))
    r = a.join(b, "cls").where("snap <> other").withColumn("lo", lo).withColumn("hi", hi)
    r = r.groupBy("cls", "snap").agg(F.max("p").alias("p"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"))
    return r.where("lowest > 0 or highest < 0").select("cls", "snap", "p", F.when(F.col("lowest") > 0, "above").otherwise("below").alias("side"), F.when(F.col("lowest") > 0, F.col("lowest")).otherwise(F.col("highest")).alias("weakest"))


def surface_split(g: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """The grid collapsed to two declared groups: difference with interval, and a verdict where a class is on one side only."""
    (one, a), (two, b) = groups.items()
    side = lambda s, c: F.sum(F.when(F.col("snap").isin(*s), F.col(c)).otherwise(0))
    t = g.groupBy("cls").agg(side(a, "n").alias("n_a"), side(b, "n").alias("n_b"), side(a, "n_snap").alias("t_a"), side(b, "n_snap").alias("t_b"))
    d, lo, hi = S.newcombe(F.col("n_a"), F.col("t_a"), F.col("n_b"), F.col("t_b"))
    ref = F.when(F.col("n_a") == 0, F.col("n_b") / F.col("t_b")).when(F.col("n_b") == 0, F.col("n_a") / F.col("t_a"))
    size = F.when(F.col("n_a") == 0, F.col("t_a")).when(F.col("n_b") == 0, F.col("t_b"))
    verdict = F.when(ref.isNotNull(), S.absence_verdict(ref * size, F.pow(1 - ref, size)))
    return t.select("cls", F.lit(one).alias("group_a"), F.lit(two).alias("group_b"), "n_a", "n_b", d.alias("d"), lo.alias("lo"), hi.alias("hi"), verdict.alias("verdict"))


def surface_many(g: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Three groups or more: counts and shares only."""
    name = F.coalesce(*[F.when(F.col("snap").isin(*s), F.lit(k)) for k, s in groups.items()])
    t = g.withColumn("grp", name).where("grp is not null").groupBy("cls", "grp").agg(F.sum("n").alias("n"), F.sum("n_snap").alias("total"))
    return t.withColumn("p", S.ratio(F.col("n").cast("double"), F.col("total")))


def exclusive_power(g: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """If the rarest class of the smaller group occurred at its rate in the larger, would a zero there be seen?"""
    t = surface_many(g, groups)
    sizes = t.groupBy("grp").agg(F.max("total").alias("total"), F.min(F.when(F.col("n") > 0, F.struct("p", "cls"))).alias("rare"))
    r = sizes.agg(F.min(F.struct("total", "grp", "rare")).alias("s"), F.max(F.struct("total", "grp")).alias("l"))
    expected = F.col("s.rare.p") * F.col("l.total")
    p_zero = F.pow(1 - F.col("s.rare.p"), F.col("l.total"))
    return r.select(F.col("s.grp").alias("smaller"), F.col("l.grp").alias("larger"), F.col("s.rare.cls").alias("rarest"), expected.alias("expected"), p_zero.alias("p_zero"), (p_zero < 0.05).alias("would_be_seen"))


def conditional_mix(df: DataFrame, outer: str, inner: str, snap: str, a: str, b: str, least: int = MIN_ROWS) -> DataFrame:
    """Inside each outer class: total variation of the inner classes between two snapshots; both sides need ``least`` rows."""
    c = df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull() & F.col(snap).isin(a, b)).groupBy(F.col(outer).alias("outer"), F.col(inner).alias("inner")).agg(F.sum((F.col(snap) == a).cast("long")).alias("n_a"), F.sum((F.col(snap) == b).cast("long")).alias("n_b"))
    w = Window.partitionBy("outer")
    c = c.withColumn("t_a", F.sum("n_a").over(w)).withColumn("t_b", F.sum("n_b").over(w)).where((F.col("t_a") >= least) & (F.col("t_b") >= least))
    return c.groupBy("outer").agg(F.max("t_a").alias("n_a"), F.max("t_b").alias("n_b"), (F.sum(F.abs(F.col("n_a") / F.col("t_a") - F.col("n_b") / F.col("t_b"))) / 2).alias("tvd"), F.count("*").alias("inner_classes"))


def movement(g: DataFrame, a: str, b: str) -> DataFrame:
    """Two snapshots: shares by rows and weight, their changes, pooled z, and a bucket of stable, emergent, receded or thin."""
    side = lambda s, c: F.sum(F.when(F.col("snap") == s, F.col(c)).otherwise(0))
    t = g.groupBy("cls").agg(*[side(s, c).alias(f"{c}_{x}") for s, x in ((a, "a"), (b, "b")) for c in ("n", "w", "n_snap", "w_snap")])
    p = lambda x: S.ratio(F.col(f"n_{x}").cast("double"), F.col(f"n_snap_{x}"))
    w = lambda x: S.ratio(F.col(f"w_{x}"), F.col(f"w_snap_{x}"))
    total = F.col("n_a") + F.col("n_b")
    minor = F.least("n_a", "n_b") / total
    bucket = F.when((F.col("n_a") < MIN_ROWS) & (F.col("n_b") < MIN_ROWS), "thin").when((minor <= 0.05) & (total >= MIN_ROWS) & (F.col("n_b") > F.col("n_a")), "emergent").when((minor <= 0.05) & (total >= MIN_ROWS), "receded").otherwise("stable")
    d, lo, hi = S.newcombe(F.col("n_a"), F.col("n_snap_a"), F.col("n_b"), F.col("n_snap_b"))
    return t.select("cls", "n_a", "n_b", p("a").alias("p_a"), p("b").alias("p_b"), d.alias("d"), lo.alias("lo"), hi.alias("hi"), (w("b") - w("a")).alias("d_weight"), S.z_two_proportions(F.col("n_a"), F.col("n_snap_a"), F.col("n_b"), F.col("n_snap_b")).alias("z"), bucket.alias("bucket"))


def delta_concentration(df: DataFrame, cls: str, snap: str, text: str, weight: Column, a: str, b: str) -> DataFrame:
    """Is the movement of a class one text? Share of the first 1 and 5 texts and HHI of the absolute changes of weight."""
    w = F.coalesce(weight, F.lit(0.0))
    t = df.where(F.col(cls).isNotNull() & F.col(text).isNotNull() & F.col(snap).isin(a, b)).groupBy(F.col(cls).alias("cls"), F.col(text).alias("text")).agg(F.abs(F.sum(F.when(F.col(snap) == b, w).otherwise(-w))).alias("d"))
    # each task sends the five largest changes of a class
    r = t.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.col("d").desc(), F.col("text").asc()))).where("r <= 5")
    s = t.groupBy("cls").agg(F.sum("d").alias("moved"), F.sum(F.col("d") * F.col("d")).alias("_q")).join(r.groupBy("cls").agg(F.max(F.when(F.col("r") == 1, F.col("d"))).alias("_1"), F.sum("d").alias("_5")), "cls")
    return s.select("cls", "moved", S.ratio(F.col("_1"), F.col("moved")).alias("top1"), S.ratio(F.col("_5"), F.col("moved")).alias("top5"), S.ratio(F.col("_q"), F.col("moved") * F.col("moved")).alias("hhi"))


def snapshot_purity(g: DataFrame, a: str, least: int = MIN_ROWS) -> DataFrame:
    """Classes of ``least`` rows or more: share of rows in snapshot a, and whether it is nearly all or nearly none."""
    t = g.groupBy("cls").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("snap") == a, F.col("n")).otherwise(0)).alias("n_a")).where(F.col("n") >= least)
    share = F.col("n_a") / F.col("n")
    return t.select("cls", "n", share.alias("share_a"), F.when(share > 0.95, "nearly all").when(share < 0.05, "nearly none").otherwise("mixed").alias("verdict"))


def churn(df: DataFrame, snap: str, text: str, weight: Column, a: str, b: str) -> DataFrame:
    """Overlap of the distinct texts of two snapshots, and the share of weight the common ones have on each side."""
    w = F.coalesce(weight, F.lit(0.0))
    t = df.where(F.col(text).isNotNull() & F.col(snap).isin(a, b)).groupBy(text).agg(F.max((F.col(snap) == a).cast("long")).alias("in_a"), F.max((F.col(snap) == b).cast("long")).alias("in_b"), F.sum(F.when(F.col(snap) == a, w).otherwise(0.0)).alias("w_a"), F.sum(F.when(F.col(snap) == b, w).otherwise(0.0)).alias("w_b"))
    both = F.col("in_a") * F.col("in_b")
    s = t.agg(F.sum("in_a").alias("texts_a"), F.sum("in_b").alias("texts_b"), F.sum(both).alias("shared"), F.count("*").alias("_u"), F.sum("w_a").alias("_wa"), F.sum("w_b").alias("_wb"), F.sum(both * F.col("w_a")).alias("_sa"), F.sum(both * F.col("w_b")).alias("_sb"))
    return s.select("texts_a", "texts_b", "shared", S.ratio(F.col("shared").cast("double"), F.col("_u")).alias("jaccard"), S.ratio(F.col("_sa"), F.col("_wa")).alias("shared_weight_a"), S.ratio(F.col("_sb"), F.col("_wb")).alias("shared_weight_b"))


def turnover(df: DataFrame, cls: str, snap: str, text: str, a: str, b: str) -> DataFrame:
    """Texts that stay, go and come between two snapshots, by class (the smallest class of a text)."""
    t = df.where(F.col(text).isNotNull() & F.col(snap).isin(a, b)).groupBy(text).agg(F.min(cls).alias("cls"), F.max((F.col(snap) == a).cast("int")).alias("in_a"), F.max((F.col(snap) == b).cast("int")).alias("in_b"))
    bucket = F.when((F.col("in_a") == 1) & (F.col("in_b") == 1), "stay").when(F.col("in_a") == 1, "gone").otherwise("new")
    c = t.groupBy(bucket.alias("bucket"), "cls").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bucket")))


def overlap(df: DataFrame, snap: str, text: str, snapshots: list[str]) -> DataFrame:
    """Directed overlap: share of the distinct texts of one snapshot that another has. One bit a snapshot, no pairs of texts."""
    t = df.where(F.col(text).isNotNull() & F.col(snap).isin(*snapshots)).groupBy(text).agg(*[F.max((F.col(snap) == s).cast("long")).alias(f"_{i}") for i, s in enumerate(snapshots)])
    sums = t.agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"_{i}_{j}") for i in range(len(snapshots)) for j in range(len(snapshots))])
    rows = [F.struct(F.lit(a).alias("snap_a"), F.lit(b).alias("snap_b"), F.col(f"_{i}_{j}").alias("common"), S.ratio(F.col(f"_{i}_{j}").cast("double"), F.col(f"_{i}_{i}")).alias("overlap")) for i, a in enumerate(snapshots) for j, b in enumerate(snapshots) if i != j]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def crosstab(df: DataFrame, category: str, cls: str, weight: Column) -> DataFrame:
    """Rows and weight by category and class, and the share within the category."""
    t = df.where(F.col(category).isNotNull() & F.col(cls).isNotNull()).groupBy(F.col(category).alias("category"), F.col(cls).alias("cls")).agg(F.count("*").alias("n"), F.sum(F.coalesce(weight, F.lit(0.0))).alias("w"))
    by = Window.partitionBy("category")
    return t.withColumn("p", F.col("n") / F.sum("n").over(by)).withColumn("wp", S.ratio(F.col("w"), F.sum("w").over(by)))


def concentration(ct: DataFrame) -> DataFrame:
    """Per class of a crosstab: rows, categories, its first category and that one's share."""
    r = ct.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.col("n").desc(), F.col("category").asc())))
    t = r.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("categories"), F.max(F.when(F.col("r") == 1, F.col("category"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("_1"))
    return t.select("cls", "n", "categories", "first", (F.col("_1") / F.col("n")).alias("first_share"))


def composition(df: DataFrame, outer: str, inner: str, snap: str) -> DataFrame:
    """Inner classes inside (outer, snapshot), with interval, in order of size with the running share."""
    t = df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull() & F.col(snap).isNotNull()).groupBy(F.col(outer).alias("outer"), F.col(snap).alias("snap"), F.col(inner).alias("inner")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("outer", "snap")
    o = w.orderBy(F.col("n").desc(), F.col("inner").asc())
    t = t.withColumn("t", F.sum("n").over(w)).withColumn("r", F.row_number().over(o)).withColumn("run", F.sum("n").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    lo, hi = S.wilson(F.col("n"), F.col("t"))
    return t.select("outer", "snap", "inner", "n", (F.col("n") / F.col("t")).alias("p"), lo.alias("lo"), hi.alias("hi"), "r", (F.col("run") / F.col("t")).alias("running"))


def structure(comp: DataFrame, mass: float = 0.8) -> DataFrame:
    """Per (outer, snapshot): inner classes, effective number, how many reach ``mass``, the first one."""
    before = F.col("running") - F.col("p")
    return comp.groupBy("outer", "snap").agg(
        F.count("*").alias("inner_classes"), F.exp(S.entropy(F.col("p"))).alias("effective"), F.sum((before < mass - 1e-9).cast("long")).alias("to_mass"), F.max(F.when(F.col("r") == 1, F.col("inner"))).alias("first")
    )


def gini(df: DataFrame, group: str, weight: Column) -> DataFrame:
    """Gini coefficient of the weights above 0 in each group.

    Equal weights are counted first, so the ranked window holds distinct weights, not rows.
    """
    t = df.where(weight.isNotNull()).groupBy(F.col(group).alias("grp"), weight.alias("x")).agg(F.count("*").alias("c"))
    t = running_before(t, ["grp", "x"], "c", "before")
    # ranks before+1 .. before+c sum to c * before + c (c + 1) / 2; a group's own ranks begin at its least ``before``
    t = t.groupBy("grp").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("s"), F.min("before").alias("_start"), F.sum(F.col("x") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2)).alias("q"))
    t = t.withColumn("q", F.col("q") - F.col("_start") * F.col("s"))
    return t.select("grp", "n", (2 * F.col("q") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))
