"""Operators on vectors: encoding, centroids, margins, cohesion, silhouette, neighbours, drift.

A vector is an array of floats. Means are positional sums, combined in each task; centroids
are one row a label and are broadcast only below a checked number of values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats as S

#: Numbers a broadcast centroid table may hold.
MAX_CENTROID_VALUES = 8_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length as a matrix of unit rows, and which rows are sound (not null, not zero, finite)."""
    width = next((len(v) for v in vectors if v is not None and len(v)), 1)
    ok = np.array([v is not None and len(v) == width for v in vectors], bool)
    m = np.zeros((len(vectors), width))
    if ok.any():
        m[ok] = np.stack([np.asarray(v, np.float64) for v, o in zip(vectors, ok) if o])
    n = np.linalg.norm(m, axis=1)
    ok &= np.isfinite(n) & (n > 0)
    m[~ok] = 0
    m[ok] /= n[ok][:, None]
    return m, ok


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unit(v: pd.Series) -> pd.Series:
    m, ok = _matrix(v)
    return pd.Series([list(r) if o else None for r, o in zip(m, ok)], index=v.index, dtype=object)


def unit(a: Column) -> Column:
    """A vector of length 1; null for vectors that are null, zero, not finite or of another length than the rest.

    Arrow batches through NumPy: nested array functions would compute the norm once an element.
    """
    return _unit.asNondeterministic()(a)


def hashing_encoder(df: DataFrame, text: str, dim: int = 256, shortest: int = 1, longest: int = 3, seed: int = 0) -> DataFrame:
    """``encoding``: signed hashing of character grams, of length 1.

    A gram's place and sign come from the first eight hexadecimal digits of md5("seed:gram"); grams are hashed once a task.
    Null and empty texts give zeros.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        out = np.zeros((len(texts), dim))
        for row, t in enumerate(texts):
            for k in range(shortest, longest + 1):
                for j in range(len(t or "") - k + 1):
                    g = t[j : j + k]
                    at = known.get(g)
                    if at is None:
                        h = int(hashlib.md5(f"{seed}:{g}".encode()).hexdigest()[:8], 16)
                        at = known[g] = (h % dim, 1.0 if h % 2 else -1.0)
                    out[row, at[0]] += at[1]
        n = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, n, out=out, where=n > 0)
        return pd.Series(list(out), index=texts.index)

    return df.withColumn("encoding", encode(F.col(text)))


def hybrid(a: Column, b: Column, alpha: float) -> Column:
    """Unit vector of a beside alpha times b; the weight of b in a cosine is alpha squared."""
    return unit(F.concat(F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double") * alpha)))


def surface_vote_share(alpha: float) -> float:
    return alpha * alpha / (1 + alpha * alpha)


def sums(df: DataFrame, label: str, vec: str) -> DataFrame:
    """label, n, s: the sum of the unit vectors of each label."""
    u = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), unit(F.col(vec)).alias("v")).where("v is not null")
    p = u.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return p.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("s"))


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """label, n, centroid: unit mean vector of each label."""
    return sums(df, label, vec).select("label", "n", unit(F.col("s")).alias("centroid"))


def _collected(cents: DataFrame, column: str, *more: str) -> tuple[list, np.ndarray, list]:
    """Labels in order, their vectors as a matrix and further columns; refuses more than ``MAX_CENTROID_VALUES`` numbers."""
    n = cents.agg(F.sum(F.size(column))).head()[0] or 0
    if n > MAX_CENTROID_VALUES:
        raise ValueError(f"{n} centroid values are too many to broadcast")
    rows = sorted(cents.where(F.col(column).isNotNull()).select("label", column, *more).collect(), key=lambda r: r[0])
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1), [tuple(r[2:]) for r in rows]


def _through(df: DataFrame, vec: str, keep: list[str], extra: list[T.StructField], compute) -> DataFrame:
    """``keep`` and what ``compute`` makes of the matrix of unit vectors of each Arrow batch; unsound vectors have no row."""
    schema = T.StructType([*[df.schema[c] for c in keep], *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, ok = _matrix(pd.Series(batch.column(batch.num_columns - 1).to_pylist(), dtype=object))
            if ok.any():
                kept = batch.filter(pa.array(ok))
                cols = compute(m[ok], kept)
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(keep)], *[c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, from_pandas=True) for c in cols]], names=schema.names)

    return df.select(*[F.col(c) for c in keep], F.col(vec).alias("_vec")).mapInArrow(run, schema)


def assign(df: DataFrame, vec: str, cents: DataFrame, keep: list[str], ambiguous: float = 0.02) -> DataFrame:
    """``keep``, assigned, similarity, runner_up, margin, ambiguous: nearest centroid by cosine; ties go to the smaller label."""
    names, mat, _ = _collected(cents, "centroid")
    kind = cents.schema["label"].dataType
    label = np.array(names, dtype=object)

    def compute(m: np.ndarray, _: pa.RecordBatch) -> list:
        c = m @ mat.T
        order = np.argsort(-c, axis=1, kind="stable")[:, :2]
        first = np.take_along_axis(c, order[:, :1], 1)[:, 0]
        if len(names) < 2:
            return [label[order[:, 0]].tolist(), first, [None] * len(m), [None] * len(m), [False] * len(m)]
        second = np.take_along_axis(c, order[:, 1:2], 1)[:, 0]
        return [label[order[:, 0]].tolist(), first, label[order[:, 1]].tolist(), first - second, first - second < ambiguous]

    fields = [T.StructField("assigned", kind), T.StructField("similarity", T.DoubleType()), T.StructField("runner_up", kind), T.StructField("margin", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    if not names:
        return df.select(*keep, *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).limit(0)
    return _through(df, vec, keep, fields, lambda m, b: [pa.array(x, type=t) if isinstance(x, list) else x for x, t in zip(compute(m, b), _arrow_types(fields))])


def _arrow_types(fields: list[T.StructField]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in fields]


def _checked(cents: DataFrame) -> DataFrame:
    """All centroids as one array, if they are few enough."""
    n = cents.agg(F.sum(F.size("centroid"))).head()[0] or 0
    if n > MAX_CENTROID_VALUES:
        raise ValueError(f"{n} centroid values are too many to broadcast")
    return cents.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_c"))


def cohesion(df: DataFrame, group: str, vec: str, least: int = 10) -> DataFrame:
    """Mean pairwise cosine within each group, from the sum of its unit vectors; no pairs are formed."""
    s = sums(df, group, vec)
    mean = (dot(F.col("s"), F.col("s")) - F.col("n")) / (F.col("n").cast("double") * (F.col("n") - 1))
    return s.select(F.col("label").alias("grp"), "n", F.when(F.col("n") > 1, mean).alias("cohesion"), (F.col("n") < least).alias("too_small"))


def cohesion_lift(df: DataFrame, group: str, vec: str, least_lift: float = 1.35) -> DataFrame:
    """Cohesion of each group over that of all rows; trusted from ``least_lift``."""
    all_ = cohesion(df.withColumn("_all", F.lit("all")), "_all", vec).select(F.col("cohesion").alias("baseline"))
    t = cohesion(df, group, vec).join(F.broadcast(all_), F.lit(True))
    lift = S.ratio(F.col("cohesion"), F.col("baseline"))
    return t.withColumn("lift", lift).withColumn("verdict", F.when(F.col("too_small"), "too small").when(lift >= least_lift, "trusted").otherwise("not trusted"))


def centroid_pairs(cents: DataFrame, least: float = 0.6, top: int = 40) -> DataFrame:
    """Pairs of centroids with a cosine of ``least``, nearest first; centroids are a checked, small table."""
    one = _checked(cents)
    e = one.select(F.explode("_c").alias("a"), "_c").select(F.col("a.label").alias("label_a"), F.col("a.centroid").alias("ca"), F.explode("_c").alias("b"))
    p = e.where(F.col("label_a") < F.col("b.label")).select("label_a", F.col("b.label").alias("label_b"), dot(F.col("ca"), F.col("b.centroid")).alias("cosine"))
    return p.where(F.col("cosine") >= least).orderBy(F.col("cosine").desc(), "label_a", "label_b").limit(top)


def silhouette(df: DataFrame, label: str, vec: str, keep: list[str]) -> DataFrame:
    """Exact cosine silhouette of every row: mean distances follow from the sums of unit vectors, so no pairs are formed.

    Rows of a label of one have 0; with fewer than two labels there is no result.
    """
    names, mat, more = _collected(sums(df, label, vec), "s", "n")
    if len(names) < 2:
        return df.select(*keep, F.lit(None).cast("double").alias("silhouette")).limit(0)
    n = np.array([m[0] for m in more], np.float64)
    at = {v: i for i, v in enumerate(names)}

    def compute(m: np.ndarray, batch: pa.RecordBatch) -> list:
        own = np.array([at[v] for v in batch.column(len(keep)).to_pylist()])
        p = m @ mat.T
        rows = np.arange(len(m))
        a = (n[own] - p[rows, own]) / np.maximum(n[own] - 1, 1)
        d = 1 - p / n[None]
        d[rows, own] = np.inf
        b = d.min(1)
        return [batch.column(len(keep)), np.where(n[own] <= 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))]

    rows = df.where(F.col(label).isNotNull()).withColumn("_label", F.col(label))
    out = _through(rows, vec, [*keep, "_label"], [T.StructField("silhouette", T.DoubleType())], lambda m, b: [compute(m, b)[1]])
    return out.select(*keep, "silhouette")


def purity(df: DataFrame, reference: str, cluster: str) -> DataFrame:
    """Share of rows in the largest reference class of their cluster."""
    c = df.where(F.col(reference).isNotNull() & F.col(cluster).isNotNull()).groupBy(cluster, reference).agg(F.count("*").alias("n"))
    m = c.groupBy(cluster).agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return m.agg(F.sum("t").alias("n"), (F.sum("m") / F.sum("t")).alias("purity"))


def heldout(df: DataFrame, label: str, vec: str, unique: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Centroids from most rows, agreement of the others, chosen by a seeded hash."""
    out = (F.pmod(F.xxhash64(F.lit(seed), F.col(unique)), F.lit(1000)) < int(1000 * fraction))
    c = centroids(df.where(~out), label, vec)
    a = assign(df.where(out), vec, c, [label])
    return a.agg(F.count("*").alias("n"), F.avg((F.col("assigned") == F.col(label)).cast("int")).alias("agreement"))


def novelty(df: DataFrame, vec: str, cents: DataFrame, keep: list[str], share: float = 0.01) -> DataFrame:
    """Rows among the ``share`` least similar to any centroid; the bound is an exact percentile."""
    a = assign(df, vec, cents, keep)
    bound = a.agg(F.percentile("similarity", F.lit(share)).alias("_b"))
    return a.join(F.broadcast(bound), F.lit(True)).where(F.col("similarity") <= F.col("_b")).select(*keep, "assigned", "similarity")


_HIT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("cosine", T.DoubleType())])


def nearest(df: DataFrame, unique: str, vec: str, queries: DataFrame, k: int, most_queries: int = 200_000, block: int = 4096) -> DataFrame:
    """query_id, place, id, cosine: the ``k`` rows nearest each of a stated set of queries (unique, vec), itself excluded.

    The queries are a checked, bounded set; all rows pass them in blocks, each task keeps k per
    query and only these meet in a shuffle. Ties go to the smaller id; cosines are rounded to six decimals.
    """
    q = queries.select(F.col(unique).cast("bigint").alias("id"), unit(F.col(vec)).alias("v")).where("v is not null").limit(most_queries + 1).collect()
    if len(q) > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    ids = np.array([r.id for r in q], np.int64)
    mat = np.array([r.v for r in q], np.float64).reshape(len(q), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_c = np.full((len(ids), k), -2.0)
        best_i = np.full((len(ids), k), -1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                rid = b.column(0).to_numpy(zero_copy_only=False)
                x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
                for lo in range(0, len(ids), 1024):
                    c = np.round(mat[lo : lo + 1024] @ x.T, 6)
                    c[ids[lo : lo + 1024][:, None] == rid[None]] = -2
                    cc = np.concatenate([best_c[lo : lo + 1024], c], 1)
                    ii = np.concatenate([best_i[lo : lo + 1024], np.broadcast_to(rid, c.shape)], 1)
                    order = np.lexsort((ii, -cc), axis=1)[:, :k]
                    best_c[lo : lo + 1024] = np.take_along_axis(cc, order, 1)
                    best_i[lo : lo + 1024] = np.take_along_axis(ii, order, 1)
        a, j = np.nonzero(best_c > -2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(best_i[a, j]), pa.array(best_c[a, j])], names=_HIT.names)

    rows = df.select(F.col(unique).cast("bigint").alias("id"), unit(F.col(vec)).alias("v")).where("v is not null")
    hits = rows.mapInArrow(run, _HIT)
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), F.col("id").asc())
    return hits.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def knn_label_scan(df: DataFrame, unique: str, vec: str, label: str, queries: DataFrame, k: int = 10, disagreement: float = 0.8) -> DataFrame:
    """Share of the ``k`` nearest of each query with another label; flagged from ``disagreement``."""
    hits = nearest(df, unique, vec, queries, k)
    of = df.select(F.col(unique).cast("bigint").alias("id"), F.col(label).alias("nn_label"))
    own = queries.select(F.col(unique).cast("bigint").alias("query_id"), F.col(label).alias("own_label"))
    j = hits.join(of, "id").join(own, "query_id")
    t = j.groupBy("query_id").agg(F.count("*").alias("n"), F.avg((~F.col("nn_label").eqNullSafe(F.col("own_label"))).cast("int")).alias("disagreement"))
    return t.withColumn("flagged", F.col("disagreement") >= disagreement)


def active_learning_batch(assigned: DataFrame, unique: str, batch: int = 200, diverse: float = 0.3, seed: int = 0) -> DataFrame:
    """Most of a batch by smallest margin, the rest uncertain rows spread over their classes."""
    near = round(batch * (1 - diverse))
    first = assigned.orderBy(F.col("margin").asc_nulls_last(), F.col(unique).asc()).limit(near).select(unique, F.lit("margin").alias("why"))
    rest = assigned.join(first.select(unique), unique, "left_anti").where("ambiguous or margin is not null")
    w = Window.partitionBy("assigned").orderBy(F.col("margin").asc_nulls_last(), F.xxhash64(F.lit(seed), F.col(unique)))
    spread = rest.withColumn("_r", F.row_number().over(w)).orderBy("_r", "margin", unique).limit(batch - near).select(unique, F.lit("diverse").alias("why"))
    return first.unionByName(spread)
