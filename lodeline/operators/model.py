"""Sparse text features, classifiers with cross-validation, two-sample tests, resampling."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats as S
from ..functions.text import grams
from ..session import HOT_KEYS, join_aggregate, materialise
from .sampling import hash_order as random_order


def tfidf(df: DataFrame, unique: str, text: str, shortest: int = 1, longest: int = 3, min_df: int = 2, sublinear: bool = True) -> DataFrame:
    """unique, term, weight: character grams with smoothed idf, rows of length 1.

    Grams are counted as runs of a sorted array in the row of their id, not by a hash table of ids
    and grams, which would hold the whole result; the texts of an id therefore meet in one row.
    Up to ``HOT_KEYS`` terms are broadcast and the rows stay where they are; more are joined without
    a hot task. Rows without an id count for the idf, as one.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(unique).alias("id"), F.lower(text).alias("text"))
    each = rows.where("id is not null").groupBy("id").agg(F.collect_list("text").alias("texts"))
    g = each.select("id", F.sort_array(F.flatten(F.transform("texts", lambda x: grams(x, shortest, longest)))).alias("g")).where(F.size("g") > 0)
    g = g.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: (i == 0) | (F.get("g", i) != F.get("g", i - 1))))
    runs = F.transform("at", lambda i, k: F.struct(F.get("g", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("g")) - i).alias("tf")))
    tf = g.select("id", F.inline(runs))
    lost = rows.where("id is null").select(F.explode(grams(F.col("text"), shortest, longest)).alias("term")).distinct()
    dfs = tf.select("term").unionByName(lost).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    idf = materialise(dfs.select("term", "df", (F.ln((1 + F.lit(rows.count())) / (1 + F.col("df"))) + 1).alias("idf")))
    terms, total = idf.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).head()
    w = (1 + F.ln("tf") if sublinear else F.col("tf")) * F.col("idf")
    t = (tf.join(F.broadcast(idf), "term") if terms <= HOT_KEYS else join_aggregate(tf, idf, ["term"], "df", total)).select("id", "term", w.alias("w"))
    t = t if terms <= HOT_KEYS else materialise(t)
    norm = t.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
    return t.join(norm.hint("shuffle_hash"), "id").select(F.col("id").alias(unique), "term", (F.col("w") / F.col("_l")).alias("weight"))


MAX_CLASSES = 10_000


def cross_validated(df: DataFrame, vec: str, label: str, unique: str, grid: tuple[float, ...] = (0.0, 0.01, 0.1), folds: int = 3, seed: int = 0) -> tuple[DataFrame, float]:
    """Out-of-fold predictions (unique, label, predicted, confidence) of the best penalty of a logistic regression, and that penalty.

    Folds are hashes of the id; classes with fewer rows than folds are dropped, more than ``MAX_CLASSES`` classes are refused.
    """
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).count().where(F.col("count") >= folds).select(label)
    sizes = sizes.limit(MAX_CLASSES + 1).collect()
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    sizes = df.sparkSession.createDataFrame([(r[0],) for r in sizes], T.StructType([T.StructField(label, df.schema[label].dataType)]))
    rows = df.join(F.broadcast(sizes), label, "left_semi").where(F.col(vec).isNotNull())
    rows = materialise(rows.select(F.col(unique).alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).alias("v"), F.pmod(F.xxhash64(F.lit(seed), F.col(unique)), F.lit(folds)).alias("fold")))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    names = F.array(*[F.lit(x) for x in index.labels])
    feats = index.transform(rows).withColumn("features", array_to_vector(F.transform("v", lambda x: x.cast("double"))))
    best, best_accuracy, best_c = None, -1.0, grid[0]
    for c in grid:
        out = None
        for k in range(folds):
            m = LogisticRegression(labelCol="y", regParam=c, maxIter=50).fit(feats.where(F.col("fold") != k))
            p = m.transform(feats.where(F.col("fold") == k)).select("id", "label", F.get(names, F.col("prediction").cast("int")).alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))
            out = p if out is None else out.unionByName(p)
        out = materialise(out)
        accuracy = out.agg(F.avg((F.col("label") == F.col("predicted")).cast("int"))).head()[0] or 0.0
        if accuracy > best_accuracy:
            best, best_accuracy, best_c = out, accuracy, c
    return best.withColumnRenamed("id", unique), best_c


def class_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 by class."""
    t = predicted.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    a = t.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    b = t.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("m"))
    r = a.join(b, "label", "left").fillna(0, ["m"])
    p, q = S.ratio(F.col("hit").cast("double"), F.col("m")), F.col("hit") / F.col("n")
    return r.select("label", "n", p.alias("precision"), q.alias("recall"), F.coalesce(2 * F.col("hit") / (F.col("n") + F.col("m")), F.lit(0.0)).alias("f1"))


def class_confidence(df: DataFrame, cls: str, snap: str, confidence: str, ambiguous: str, least: int = 20) -> DataFrame:
    """Mean confidence and share of ambiguous rows by class and snapshot; the lowest snapshot among those of ``least`` rows, and the range."""
    c = F.col(confidence)
    t = df.where(F.col(cls).isNotNull() & F.col(snap).isNotNull() & c.isNotNull() & ~F.isnan(c)).groupBy(F.col(cls).alias("cls"), F.col(snap).alias("snap")).agg(F.count("*").alias("n"), F.avg(c).alias("confidence"), F.avg(F.col(ambiguous).cast("int")).alias("ambiguous"))
    w = Window.partitionBy("cls")
    enough = F.when(F.col("n") >= least, F.struct("confidence", "snap"))
    return t.withColumn("lowest", F.min(enough).over(w)["snap"]).withColumn("range", F.max("confidence").over(w) - F.min("confidence").over(w))


def examples(df: DataFrame, cls: str, snap: str, unique: str, weight: Column, quotable: Column, per: int = 3, seed: int = 0) -> DataFrame:
    """Per class and snapshot the ``per`` quotable rows of most weight, and as many at random from the rest."""
    r = df.where(F.col(cls).isNotNull() & F.col(snap).isNotNull() & F.coalesce(quotable, F.lit(False))).select(F.col(cls).alias("cls"), F.col(snap).alias("snap"), F.col(unique).alias("id"), F.coalesce(weight, F.lit(0.0)).alias("w"))
    w = Window.partitionBy("cls", "snap")
    place = lambda *o: F.row_number().over(w.orderBy(*o)).cast("bigint")  # noqa: E731 - each task sends only the first rows of a group
    top = r.withColumn("place", place(F.col("w").desc(), F.col("id").asc())).where(F.col("place") <= per)
    drawn = random_order(seed, "id")
    # at most ``per`` of the first rows by hash are top rows themselves
    some = r.withColumn("place", place(drawn, "id")).where(F.col("place") <= 2 * per).drop("place").join(top.select("cls", "snap", "id"), ["cls", "snap", "id"], "left_anti")
    some = some.withColumn("place", place(drawn, "id")).where(F.col("place") <= per)
    return top.withColumn("kind", F.lit("top")).unionByName(some.withColumn("kind", F.lit("random"))).select("cls", "snap", "kind", "place", "id")


def weighted_quantile(df: DataFrame, group: str, value: Column, weight: Column, q: float) -> DataFrame:
    """The first value whose running share of the weight reaches q; equal values are added up first."""
    t = df.where(value.isNotNull() & weight.isNotNull()).groupBy(F.col(group).alias("grp"), value.alias("x")).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy("grp")
    t = t.withColumn("_run", F.sum("w").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("w").over(w))
    return t.where(F.col("_run") >= q * F.col("_all")).groupBy("grp").agg(F.min("x").alias("quantile"))


def bootstrap_share(df: DataFrame, stratum: str, hit: Column, weight: Column, draws: int = 200, seed: int = 0) -> DataFrame:
    """Share of weight that is hit, with a 95 % interval by a Poisson bootstrap of rows: all draws share one pass.

    Each row's number of repetitions in a draw comes from a hash, so no draw shuffles rows. A
    draw is taken within each stratum: the strata keep their weight, and their shares add up by it.
    """
    rows = df.where(F.col(stratum).isNotNull() & weight.isNotNull()).select(F.col(stratum).cast("string").alias("s"), F.coalesce(hit, F.lit(False)).cast("double").alias("h"), weight.cast("double").alias("w"), F.xxhash64(*df.columns).alias("k"))
    cdf = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])  # what lies beyond is less than a step of a double

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strata, at = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            h, w, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            sums = []
            for b in range(draws + 1):
                z = k.view(np.uint64) + np.uint64((seed * 1_000_003 + b) * 0x9E3779B97F4A7C15 % 2**64)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53
                x = w * np.searchsorted(cdf, u, "right") if b else w
                sums.append((np.bincount(at, x, len(strata)), np.bincount(at, x * h, len(strata))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(strata) * (draws + 1), pa.string()), pa.array(np.repeat(np.arange(draws + 1, dtype=np.int32), len(strata))), pa.array(np.concatenate([x for x, _ in sums])), pa.array(np.concatenate([y for _, y in sums]))],
                names=["s", "b", "w", "h"],
            )

    each = rows.mapInArrow(run, "s string, b int, w double, h double").groupBy("s", "b").agg(F.sum("w").alias("w"), F.sum("h").alias("h"))
    each = each.withColumn("own", F.max(F.when(F.col("b") == 0, F.col("w"))).over(Window.partitionBy("s")))  # draws + 1 rows a stratum
    by = each.where("w > 0").groupBy("b").agg((F.sum(F.col("own") * F.col("h") / F.col("w")) / F.sum("own")).alias("share"))
    v = by.agg(F.max(F.when(F.col("b") == 0, F.col("share"))).alias("share"), F.array_sort(F.collect_list(F.when(F.col("b") > 0, F.col("share")))).alias("_d"))
    return v.select("share", F.get("_d", F.lit(int(0.025 * (draws - 1)))).alias("lo"), F.get("_d", F.lit(int(0.975 * (draws - 1)))).alias("hi"))


def auc(scores: list[tuple[float, int]]) -> float:
    """Area under the curve from (score, label) pairs of a bounded test sample; ties count half."""
    s = sorted(scores)
    ranks, i = 0.0, 0
    while i < len(s):
        j = i
        while j < len(s) and s[j][0] == s[i][0]:
            j += 1
        ranks += sum(y for _, y in s[i:j]) * (i + j + 1) / 2
        i = j
    pos = sum(y for _, y in s)
    neg = len(s) - pos
    return (ranks - pos * (pos + 1) / 2) / (pos * neg) if pos and neg else 0.5


def permutation_p(observed: float, scores: list[tuple[float, int]], draws: int = 200, seed: int = 0) -> float:
    """(1 + draws at or above the observed area) / (draws + 1), labels permuted."""
    rng = random.Random(seed)
    x, y = [a for a, _ in scores], [b for _, b in scores]
    above = 0
    for _ in range(draws):
        rng.shuffle(y)
        above += auc(list(zip(x, y))) >= observed
    return (1 + above) / (draws + 1)


def default_contrasts(snapshots: list[str], axis: str) -> list[tuple[str, str]]:
    """Time: neighbours, and the first against the last; stratum: all pairs."""
    if axis == "time":
        near = list(zip(snapshots, snapshots[1:]))
        return near + ([(snapshots[0], snapshots[-1])] if len(snapshots) > 2 else [])
    return [(a, b) for i, a in enumerate(snapshots) for b in snapshots[i + 1 :]]


def manifest(df: DataFrame, snap: str, weight: Column, axis: str) -> DataFrame:
    """Per snapshot: rows, rows with a weight, and whether weights tell nothing (all missing or all the same)."""
    w = S.positive(weight)
    t = df.where(F.col(snap).isNotNull()).groupBy(F.col(snap).alias("snap")).agg(F.count("*").alias("n"), F.count(w).alias("weighted"), F.min(w).alias("_a"), F.max(w).alias("_b"))
    return t.select("snap", "n", "weighted", (F.col("weighted").eqNullSafe(0) | F.coalesce(F.col("_a") == F.col("_b"), F.lit(True))).alias("uniform"), F.lit(axis).alias("axis"))
