"""Clustering: k-means sweeps, replay stability, two-level trees, refinement, choice of k, governance."""

from __future__ import annotations

import math

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import labels as L
from . import vectors as V

STABILITY_FLOOR, NOISE_FACTOR = 0.55, 1.4826


def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("_u", V.unit(F.col(vec))).where("_u is not null").withColumn("features", array_to_vector("_u")).drop("_u")


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 0, bisecting: bool = False) -> DataFrame:
    """``df`` with ``cluster``; vectors are brought to length 1, so distance and cosine agree."""
    f = _features(df, vec)
    algo = BisectingKMeans(k=k, seed=seed, maxIter=20) if bisecting else KMeans(k=k, seed=seed, maxIter=30, initMode="k-means||")
    return algo.setPredictionCol("cluster").fit(f).transform(f).drop("features")


def replay_stability(df: DataFrame, vec: str, unique: str, k: int, seeds: tuple[int, int] = (0, 1), bisecting: bool = False) -> float:
    """Adjusted Rand index of the fits of two seeds on the same rows."""
    f = _features(df, vec).select(unique, "features")
    out = None
    for i, s in enumerate(seeds):
        algo = BisectingKMeans(k=k, seed=s, maxIter=20) if bisecting else KMeans(k=k, seed=s, maxIter=30)
        p = algo.setPredictionCol(f"c{i}").fit(f).transform(f).select(unique, f"c{i}") if out is None else algo.setPredictionCol(f"c{i}").fit(f.select(unique, "features")).transform(f).select(unique, f"c{i}")
        out = p if out is None else out.join(p, unique)
    return L.score_partition(out, "c0", "c1").head()["ari"]


def sweep(df: DataFrame, vec: str, unique: str, ks: list[int], reference: str | None = None) -> list[dict[str, float]]:
    """For each k: stability, mean cosine silhouette, and agreement with a reference partition if there is one."""
    held = materialise(df)
    rows = []
    for k in ks:
        c = kmeans(held, vec, k)
        row = {"k": k, "stability": replay_stability(held, vec, unique, k), "silhouette": V.silhouette(c, "cluster", vec, [unique]).agg(F.avg("silhouette")).head()[0] or 0.0}
        if reference:
            s = L.score_partition(c, reference, "cluster").head()
            row |= {"ami": s["ami"], "purity": s["purity"]}
        rows.append(row)
    return rows


def algorithm_battery(df: DataFrame, vec: str, unique: str, ks: list[int]) -> list[dict[str, float | str]]:
    """k-means and bisecting k-means through one harness, and the paired margin within each k."""
    held = materialise(df)
    return [{"algorithm": a, "k": k, "stability": replay_stability(held, vec, unique, k, bisecting=a == "bisecting")} for k in ks for a in ("kmeans", "bisecting")]


def triangulate(rows: list[dict[str, float]], key: str = "ami", floor: float = STABILITY_FLOOR, band: float = 0.02) -> dict[str, float | list | str | None]:
    """The smallest k whose ``key`` is within the measured band of the best, among stable ones."""
    stable = [r for r in rows if r["stability"] >= floor]
    if not stable:
        return {"k": None, "tied": [], "agreement": "none"}
    noise = noise_floor([r[key] for r in rows])
    width = max(band, 0.0 if math.isnan(noise) else noise)
    best = max(r[key] for r in stable)
    tied = sorted(r["k"] for r in stable if r[key] >= best - width)
    return {"k": tied[0], "tied": tied, "band": width, "agreement": "measured_only"}


def noise_floor(values: list[float]) -> float:
    """Noise of a sweep: scaled median absolute deviation of successive differences over the root of two; NaN below four values."""
    if len(values) < 4:
        return math.nan
    d = [b - a for a, b in zip(values, values[1:])]
    mid = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    m = mid(d)
    return NOISE_FACTOR * mid([abs(x - m) for x in d]) / math.sqrt(2)


def two_level(df: DataFrame, vec: str, unique: str, families: int, min_leaf: int = 150, min_share: float = 0.003, most_leaves: int = 8, seed: int = 0) -> DataFrame:
    """family and leaf: k-means families, each split by k-means into leaves that keep a least size, or not at all."""
    top = materialise(kmeans(df, vec, families, seed).withColumnRenamed("cluster", "family"))
    n = top.count()
    least = max(min_leaf, math.ceil(min_share * n))
    out, base = None, 0
    for fam, size in sorted((r.family, r["count"]) for r in top.groupBy("family").count().collect()):
        part = top.where(F.col("family") == fam)
        k = min(most_leaves, size // least)
        while k >= 2:
            split = kmeans(part, vec, k, seed)
            if min(r["count"] for r in split.groupBy("cluster").count().collect()) >= least:
                break
            k -= 1
        split = split if k >= 2 else part.withColumn("cluster", F.lit(0))
        split = split.withColumn("leaf", F.col("cluster") + base).drop("cluster")
        base += max(1, k)
        out = split if out is None else out.unionByName(split)
    return out


def refine(df: DataFrame, vec: str, unique: str, label: str, rounds: int = 5, merge_cosine: float = 0.92, tolerance: float = 0.005) -> DataFrame:
    """Merge labels whose centroids are nearly one direction and reassign rows, until fewer than ``tolerance`` move."""
    now = df.select(unique, vec, F.col(label).alias("label"))
    for _ in range(rounds):
        cents = V.centroids(now, "label", vec)
        pairs = [(r.label_a, r.label_b) for r in V.centroid_pairs(cents, merge_cosine, 10_000).collect()]
        root = follow({b: a for a, b in reversed(pairs)})
        merged = now.replace(root, subset=["label"]) if root else now
        cents = V.centroids(merged, "label", vec)
        moved = V.assign(merged, vec, cents, [unique, vec, "label"])
        moved = materialise(moved.select(unique, vec, F.col("assigned").alias("label"), F.col("label").alias("_was")))
        share = moved.agg(F.avg((F.col("label") != F.col("_was")).cast("int"))).head()[0] or 0.0
        now = moved.drop("_was")
        if share < tolerance and not root:
            break
    return now


def follow(merges: dict) -> dict:
    """Each label's root along a chain of merges; cycles end at their smallest member."""
    out = {}
    for x in merges:
        seen = [x]
        while seen[-1] in merges and merges[seen[-1]] not in seen:
            seen.append(merges[seen[-1]])
        nxt = merges.get(seen[-1])
        out[x] = min(seen[seen.index(nxt) :]) if nxt in seen else seen[-1]
    return {k: v for k, v in out.items() if k != v}


def partition_stability(df: DataFrame, vec: str, unique: str, label: str, splits: int = 3) -> list[float]:
    """Does this partition replay? Centroids of a random half give labels to the other half; ARI with its own labels."""
    out = []
    for s in range(splits):
        half = F.pmod(F.xxhash64(F.lit(s), F.col(unique)), F.lit(2)) == 0
        a = V.assign(df.where(~half), vec, V.centroids(df.where(half), label, vec), [label])
        out.append(L.score_partition(a, label, "assigned").head()["ari"])
    return out


def apply_merges(families: dict[int, int], merges: dict[int, int]) -> dict[int, int]:
    """Leaf to family after merges of families, numbered densely."""
    root = follow(merges)
    mapped = {leaf: root.get(f, f) for leaf, f in families.items()}
    dense = {f: i for i, f in enumerate(sorted(set(mapped.values())))}
    return {leaf: dense[f] for leaf, f in mapped.items()}


def isolate(families: dict[int, int], leaves: list[int]) -> tuple[dict[int, int], list[int]]:
    """Leaves moved to families of their own; ids that do not exist are returned."""
    out, bad = dict(families), []
    nxt = max(out.values(), default=-1) + 1
    for x in leaves:
        if x in out:
            out[x], nxt = nxt, nxt + 1
        else:
            bad.append(x)
    return out, bad


def execute_prescriptions(families: dict[int, int], prescriptions: list[dict]) -> tuple[dict[int, int], list[dict]]:
    """Settle every prescription as executed or declined, in the order merge, then isolate; isolation wins over a merge of the same leaf."""
    isolated = {t for p in prescriptions if p["kind"] == "isolate_leaf" for t in p["targets"]}
    out, ledger = dict(families), []
    for p in sorted(prescriptions, key=lambda p: {"merge_families": 0, "merge_leaves": 1, "isolate_leaf": 2}.get(p["kind"], 3)):
        why = ""
        if p["kind"] == "merge_families":
            known = [t for t in p["targets"] if t in out.values()]
            if len(known) < 2:
                why = "fewer than two of the families exist"
            else:
                out = {leaf: known[0] if f in known else f for leaf, f in out.items()}
        elif p["kind"] == "merge_leaves":
            known = [t for t in p["targets"] if t in out and t not in isolated]
            if len(known) < 2:
                why = "fewer than two of the leaves exist or may be merged"
            else:
                out |= dict.fromkeys(known, out[known[0]])
        elif p["kind"] == "isolate_leaf":
            out, bad = isolate(out, p["targets"])
            why = f"no such leaf: {bad}" if bad else ""
        elif p["kind"] not in ("flag_risk", "relabel", "keep_as_is"):
            why = f"unknown kind {p['kind']!r}"
        ledger.append({"id": p["id"], "kind": p["kind"], "status": "declined" if why else "executed", "reason": why})
    return out, ledger


def assert_settled(prescriptions: list[dict], ledger: list[dict]) -> None:
    left = {p["id"] for p in prescriptions} - {x["id"] for x in ledger if x["status"] in ("executed", "declined")}
    if left:
        raise ValueError(f"not settled: {sorted(left)}")
