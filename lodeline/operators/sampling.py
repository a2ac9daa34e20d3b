"""Sampling, cards and shaped reads. Random order is the order of a seeded hash, the same at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *columns: str) -> Column:
    """A seeded digest of the columns as text, of equal order on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def subsample(df: DataFrame, k: int, unique: str, seed: int = 0) -> DataFrame:
    """``k`` rows: those of the smallest hashes."""
    return df.orderBy(hash_order(seed, unique), unique).limit(k)


def allocate(sizes: dict[str, int], n: int) -> dict[str, int]:
    """Largest-remainder shares of ``n`` with at least one row a stratum; refuses more strata than rows."""
    if len(sizes) > n:
        raise ValueError(f"{len(sizes)} strata cannot each have one of {n} rows")
    return hamilton({k: v / max(1, sum(sizes.values())) for k, v in sizes.items()}, n, sizes, least=1)


def hamilton(shares: dict[str, float], seats: int, caps: dict[str, int], least: int = 0) -> dict[str, int]:
    """Largest-remainder seats within caps; seats above a cap go to the others."""
    out = {k: min(least, caps[k]) for k in shares}
    left = min(seats, sum(caps[k] for k in shares)) - sum(out.values())
    while left > 0:
        open_ = [k for k in shares if out[k] < caps[k]]
        mass = sum(shares[k] for k in open_) or 1.0
        want = {k: left * (shares[k] / mass if mass else 1 / len(open_)) for k in open_}
        give = {k: min(int(want[k]), caps[k] - out[k]) for k in open_}
        if not any(give.values()):
            for k in sorted(open_, key=lambda k: (-(want[k] - int(want[k])), -shares[k], k))[:left]:
                out[k] += 1
                left -= 1
            continue
        for k, g in give.items():
            out[k] += g
        left -= sum(give.values())
    return out


def stratified(df: DataFrame, n: int, stratum: str, unique: str, seed: int = 0) -> DataFrame:
    """``n`` rows in proportion to the strata, at least one each, by seeded hash within a stratum."""
    sizes = {r[0]: r[1] for r in df.where(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}  # one row a stratum, at most n
    quota = allocate(sizes, n)
    q = df.sparkSession.createDataFrame(list(quota.items()), f"{stratum} string, _q int")
    w = Window.partitionBy(stratum).orderBy(hash_order(seed, unique), unique)
    # no stratum has more seats than the largest, so each task sends no more rows of it
    return df.join(F.broadcast(q), stratum).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(quota.values(), default=0)).where("_r <= _q").drop("_r", "_q")


def per_group(df: DataFrame, group: str, n: int, unique: str, seed: int = 0) -> DataFrame:
    """``n`` random rows of every group."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, unique), unique)
    return df.where(F.col(group).isNotNull()).withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= n)


def blind_matchups(df: DataFrame, unique: str, text: str, old: str, new: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows whose labels differ with sides swapped at random, and the key apart from them."""
    d = df.where(~F.col(old).eqNullSafe(F.col(new))).withColumn("_s", hash_order(seed, unique) < "8")
    pairs = d.select(unique, text, F.when(F.col("_s"), F.col(old)).otherwise(F.col(new)).alias("side_a"), F.when(F.col("_s"), F.col(new)).otherwise(F.col(old)).alias("side_b"))
    return pairs, d.select(unique, F.when(F.col("_s"), "b").otherwise("a").alias("challenger"))


def naming_cards(df: DataFrame, cluster: str, unique: str, distance: str, seed: int = 0, near: int = 15, far: int = 5, random: int = 10) -> DataFrame:
    """Per cluster the nearest, farthest and random other members: cluster, role, place, id."""
    w = Window.partitionBy(cluster)
    r = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("cluster"), F.col(unique).alias("id"), F.col(distance).alias("d"))
    w = Window.partitionBy("cluster")
    r = r.withColumn("n1", F.row_number().over(w.orderBy(F.col("d").asc(), F.col("id").asc()))).withColumn("n2", F.row_number().over(w.orderBy(F.col("d").desc(), F.col("id").asc())))
    role = F.when(F.col("n1") <= near, "near").when(F.col("n2") <= far, "far").otherwise("random")
    r = r.withColumn("role", role)
    place = F.row_number().over(Window.partitionBy("cluster", "role").orderBy(F.when(F.col("role") == "near", F.col("n1")).when(F.col("role") == "far", F.col("n2")).otherwise(hash_order(seed, "id")), "id"))
    return r.withColumn("place", place.cast("bigint")).where((F.col("role") != "random") | (F.col("place") <= random)).select("cluster", "role", "place", "id")


def middle_exemplar(df: DataFrame, group: str, unique: str) -> DataFrame:
    """The element at position n div 2 (from 0) of the sorted ids of each group."""
    w = Window.partitionBy(group)
    r = df.where(F.col(group).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(unique))).withColumn("_n", F.count("*").over(w))
    return r.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(F.col(group).alias("grp"), F.col(unique).alias("exemplar"), F.col("_n").alias("n"))


def select_cover(df: DataFrame, cell: str, stratum: str, unique: str, centrality: str, target: float = 0.8, most: int = 8) -> DataFrame:
    """One central row a stratum, in order of size, until ``target`` of the cell or ``most`` rows are reached."""
    r = df.groupBy(cell, stratum).agg(F.count("*").alias("n"), F.min(F.struct(F.when(F.col(centrality).isNotNull(), 0).otherwise(1), -F.col(centrality), F.col(unique).alias("id")))["id"].alias("id"))
    o = Window.partitionBy(cell).orderBy(F.col("n").desc(), F.col(stratum).asc())
    r = r.withColumn("t", F.sum("n").over(Window.partitionBy(cell))).withColumn("before", F.coalesce(F.sum("n").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(o).cast("bigint"))
    return r.where((F.col("before") < target * F.col("t")) & (F.col("place") <= most)).select(F.col(cell).alias("cell"), F.col(stratum).alias("stratum"), "n", "id", "place")


def shape(df: DataFrame, where: dict[str, object] | None = None, columns: list[str] | None = None, sort: str | None = None, descending: bool = True, limit: int = 50) -> tuple[DataFrame, dict[str, int]]:
    """A served read: filter (equal, one of, ``<x``, ``>x``), project, sort with numbers as numbers and nulls last, cut, and say what was cut."""
    out = df
    for c, v in (where or {}).items():
        if isinstance(v, (list, tuple, set)):
            out = out.where(F.col(c).isin(*v))
        elif isinstance(v, str) and v[:1] in "<>" and v[1:]:
            x = F.col(c).try_cast("double") if hasattr(F.col(c), "try_cast") else F.col(c).cast("double")
            out = out.where(x < float(v[1:]) if v[0] == "<" else x > float(v[1:]))
        else:
            out = out.where(F.col(c) == v)
    matched = out.count()
    if sort:
        num, txt = F.col(sort).cast("string").try_cast("double"), F.col(sort).cast("string")
        out = out.orderBy(*([num.desc_nulls_last(), txt.desc_nulls_last()] if descending else [num.asc_nulls_last(), txt.asc_nulls_last()]))
    out = out.select(*columns) if columns else out
    return out.limit(limit), {"matched": matched, "shown": min(limit, matched), "left_out": max(0, matched - limit)}


def clip(payload: dict, most: int = 20_000) -> dict:
    """A payload within ``most`` characters: rows of its longest list go, keys never; says how many went."""
    import json

    out, gone = dict(payload), 0
    while len(json.dumps(out, ensure_ascii=False, default=str)) > most:
        lists = [k for k, v in out.items() if isinstance(v, list) and v]
        if not lists:
            break
        k = max(lists, key=lambda x: len(json.dumps(out[x], ensure_ascii=False, default=str)))
        cut = max(1, len(out[k]) // 4)
        out[k] = out[k][:-cut]
        gone += cut
    return out | {"rows_left_out": gone} if gone else out
