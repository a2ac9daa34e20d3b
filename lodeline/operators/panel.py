"""Comparing candidate partitions: margins within k, reach and choice of a locator, geometry of classes, one panel of measures."""

from __future__ import annotations

import hashlib
import json
from statistics import median

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import labels as L
from . import vectors as V
from .select import discrimination, known

#: Algorithms that assume the same round clusters.
ROUND = ("kmeans", "minibatch", "bisecting")
#: What a measure may decide.
DECISIVE, ADVISORY = ("stability", "purity", "ami", "fragmentation"), ("silhouette",)
LOWER = ("fragmentation", "ambiguous", "ece")


def paired_margins(rows: list[dict]) -> dict[int, float]:
    """By k: the stability of the best algorithm of another shape less that of the best round one."""
    out = {}
    for k in sorted({r["k"] for r in rows}):
        here = [(r["algorithm"].startswith(ROUND), r["stability"]) for r in rows if r["k"] == k and known(r.get("stability"))]
        round_, other = ([s for x, s in here if x is want] for want in (True, False))
        if round_ and other:
            out[k] = max(other) - max(round_)
    return out


def battery_verdict(rows: list[dict], least: float = 0.1) -> dict:
    """Whether an algorithm of another shape contradicts round clusters by more than ``least`` at some k; None where none was compared."""
    margins = paired_margins(rows)
    return {"margins": margins, "contradicted": max(margins.values()) > least if margins else None}


def choose_locator(reach: dict[str, dict], sweep: list[dict], least: float = 0.8) -> str | None:
    """Among references that reach ``least`` of the clusters (or all, if none does) the most discriminating, then the farthest reaching, then the widest."""
    pool = {k: v for k, v in reach.items() if (v.get("reach") or 0) >= least} or reach
    return max(sorted(pool), key=lambda k: (discrimination(sweep, pool[k]["column"]), pool[k].get("reach") or 0, pool[k].get("row_coverage") or 0), default=None)


def reference_sensitivity(sweep: list[dict], columns: list[str]) -> dict:
    """Where each reference would locate k, and whether they agree."""
    best = {c: max((r for r in sweep if known(r.get(c))), key=lambda r: (r[c], -r["k"]), default={}).get("k") for c in columns}
    return {"k": best, "agree": len({k for k in best.values() if k is not None}) <= 1}


def stability_with_error(values: list[float]) -> dict[str, float]:
    """Mean, deviation and standard error of the stabilities of several pairs of seeds."""
    n = len(values)
    mean = sum(values) / n
    sd = (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5 if n > 1 else 0.0
    return {"mean": mean, "sd": sd, "sem": sd / n**0.5}


def geometric_audit(df: DataFrame, unique: str, vec: str, label: str, queries: DataFrame, k: int = 5, chance: float = 2.0, deviations: float = 1.0, floor: float = 0.5) -> DataFrame:
    """Per class: rows, cohesion, agreement of the ``k`` nearest of its queries, bar and verdict.

    The bar is the larger of ``chance`` times the share of the class and the median agreement less
    ``deviations`` median absolute deviations (``floor`` below five classes). Classes are a short list.
    """
    cents = V.centroids(df, label, vec)
    own = V.cohesion(df, label, vec, 1).select(F.col("grp").cast("string").alias("cls"), "n", "cohesion")
    near = V.knn_label_scan(df, unique, vec, label, queries, k).join(queries.select(F.col(unique).cast("bigint").alias("query_id"), F.col(label).cast("string").alias("cls")), "query_id")
    agree = near.groupBy("cls").agg((1 - F.avg("disagreement")).alias("agreement"))
    rows = own.join(agree, "cls").collect()  # one row a class
    if cents.count() < 2 or not rows:
        return df.sparkSession.createDataFrame([], "cls string, n bigint, cohesion double, agreement double, bar double, verdict string")
    got, total = sorted(r.agreement for r in rows), sum(r.n for r in rows)
    mid = median(got)
    spread = mid - deviations * median(abs(x - mid) for x in got) if len(got) >= 5 else floor
    out = [(r.cls, r.n, r.cohesion, r.agreement, max(chance * r.n / total, spread)) for r in rows]
    return df.sparkSession.createDataFrame([(*r, "visible" if r[3] >= r[4] else "needs rules") for r in out], "cls string, n bigint, cohesion double, agreement double, bar double, verdict string")


def split_leaf(df: DataFrame, vec: str, unique: str, least: int = 60, seed: int = 0) -> DataFrame | None:
    """(unique, part): the two halves of a leaf by 2-means, or None if the leaf has fewer than twice ``least`` rows or a half fewer than ``least``."""
    if df.limit(2 * least).count() < 2 * least:
        return None
    rows = df.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    out = KMeans(k=2, seed=seed, distanceMeasure="cosine").fit(rows).transform(rows).select(unique, F.col("prediction").alias("part"))
    sizes = [r["count"] for r in out.groupBy("part").count().collect()]
    return out if len(sizes) == 2 and min(sizes) >= least else None


def governance_ledger(prescriptions: list[dict]) -> list[dict]:
    """One line a prescription: id, kind, targets, status, what speaks for it and why it was declined."""
    return [{"id": p["id"], "kind": p["kind"], "targets": ", ".join(map(str, p.get("targets", ()))), "status": p.get("status", "open"), "evidence": json.dumps(p.get("evidence", {}), sort_keys=True), "declined": p.get("decline_reason", "")} for p in prescriptions]


class Panel:
    """Measures of candidates by one code and one seed; tables of several panels are refused."""

    def __init__(self, seed: int = 0, version: str = "1") -> None:
        self.seed, self.version = seed, version
        self.rows: dict[str, tuple[str, dict[str, float]]] = {}

    @property
    def id(self) -> str:
        return hashlib.sha256(f"{self.version}:{self.seed}".encode()).hexdigest()[:12]

    def measure(self, subject: str, df: DataFrame, unique: str, vec: str, cluster: str, reference: str | None = None) -> dict[str, float]:
        s = V.silhouette(df, cluster, vec, [unique]).agg(F.avg("silhouette")).head()[0]
        out = {"silhouette": s, "clusters": df.select(cluster).distinct().count()}
        if reference:
            r = L.score_partition(df, cluster, reference).head()
            out |= {"ami": r.ami, "ari": r.ari, "purity": r.purity}
        return self.record(subject, out)

    def record(self, subject: str, measures: dict[str, float]) -> dict[str, float]:
        self.rows[subject] = (self.id, measures)
        return measures

    def table(self) -> list[dict]:
        if len({p for p, _ in self.rows.values()}) > 1:
            raise ValueError("measures of several panels cannot be compared")
        return [{"subject": s, **m} for s, (_, m) in self.rows.items()]

    def ranking(self, measure: str) -> list[tuple[str, float]]:
        """Subjects by a measure that may decide; others are refused."""
        if measure not in DECISIVE:
            raise ValueError(f"{measure!r} decides nothing; {', '.join(DECISIVE)} do")
        rows = [(s, m[measure]) for s, (_, m) in self.rows.items() if known(m.get(measure))]
        return sorted(rows, key=lambda x: (x[1] if measure in LOWER else -x[1], x[0]))
