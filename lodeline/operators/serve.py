"""Comparison tables built once, and answers served from them.

:func:`comparison` drives the operators of :mod:`.compare` over the class grid of each level
and keeps their tables by name; answers are short reads of these tables. Texts leave through
:func:`scrub`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import compare as C
from . import guard as G

BLOCKED = "[withheld]"


def comparison(df: DataFrame, levels: list[str], snap: str, weight: Column) -> dict[str, DataFrame]:
    """Tables by name (``matrix_<level>``, ``change_<level>``, ``distance_<level>``, ``absence_<level>``, ``coverage_<level>``), each written once."""
    snaps = C.snapshots_of(df, snap)
    out: dict[str, DataFrame] = {}
    for level in levels:
        g = materialise(C.grid(df, level, snap, snaps, weight))
        for name, made in (("matrix", C.matrix(g)), ("change", C.pairwise_change(g, snaps)), ("distance", C.pairwise_distance(g, snaps)), ("absence", C.absence(g)), ("coverage", C.coverage(g))):
            out[f"{name}_{level}"] = materialise(made)
    return out


def overview(df: DataFrame, levels: list[str], snap: str) -> DataFrame:
    """Per snapshot: rows and, by level, classes and labelled rows."""
    more = [x for c in levels for x in (F.count_distinct(c).alias(f"{c}_classes"), F.count(c).alias(f"{c}_rows"))]
    return df.where(F.col(snap).isNotNull()).groupBy(F.col(snap).alias("snap")).agg(F.count("*").alias("n"), *more)


def findings(tables: dict[str, DataFrame], level: str, movers: int = 6) -> DataFrame:
    """The largest significant changes of a level over all pairs of snapshots, with their place."""
    t = tables[f"change_{level}"].where("significant").withColumn("size", F.abs("d"))
    t = t.orderBy(F.col("size").desc(), "cls", "snap_a", "snap_b").limit(movers)
    # a window over at most ``movers`` rows
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.col("size").desc(), "cls", "snap_a", "snap_b")).cast("bigint")).drop("size")


def class_detail(tables: dict[str, DataFrame], level: str, name: str) -> DataFrame:
    """What is known of one class by snapshot; an unknown name is refused with those that contain it."""
    t = tables[f"matrix_{level}"]
    hit = t.where(F.col("cls") == name)
    if hit.isEmpty():
        near = [r[0] for r in t.where(F.col("cls").contains(name)).select("cls").distinct().orderBy("cls").limit(8).collect()]
        raise ValueError(f"no class {name!r} in {level}" + (f"; did you mean {near}" if near else ""))
    return hit.join(tables[f"absence_{level}"].where(F.col("cls") == name).select("cls", "snap", F.lit(True).alias("absent")), ["cls", "snap"], "left").withColumn("absent", F.coalesce("absent", F.lit(False)))


def scrub(df: DataFrame, guard: G.Guard, screened: DataFrame | None = None) -> DataFrame:
    """Every text column with what a hard, joint or declared pattern or the screened list hits withheld; NaN and infinity as null."""
    out = df
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "string":
            bad = G._any([G._hit(f.name, p) for p in (*guard.hard.values(), *guard.declared)] + [G._hit(f.name, a) & G._hit(f.name, b) for a, b in guard.together])
            if screened is not None:
                marks = screened.select(F.col(screened.columns[0]).alias(f.name)).where(F.col(f.name).isNotNull()).distinct().withColumn("_s", F.lit(True))
                out = out.join(marks, f.name, "left")
                bad = bad | F.coalesce("_s", F.lit(False))
            out = out.withColumn(f.name, F.when(bad, F.lit(BLOCKED)).otherwise(F.col(f.name))).drop("_s")
        elif kind in ("double", "float"):
            out = out.withColumn(f.name, F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)))
    return out.select(*df.columns)


def enrich(df: DataFrame, cls: str, other: str, unique: str, quotable: Column, weight: Column, texts: int = 3) -> DataFrame:
    """Per class: rows, the most frequent class of the other route with its share, and the ids of its first quotable rows by weight."""
    rows = df.where(F.col(cls).isNotNull())
    c = rows.groupBy(F.col(cls).alias("cls"), F.col(other).alias("other")).agg(F.count("*").alias("n"))
    one = c.groupBy("cls").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("other").isNotNull(), F.col("n")).otherwise(0)).alias("_known"), F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("other").alias("other")))).alias("_m"))
    w = Window.partitionBy("cls").orderBy(F.coalesce(weight, F.lit(0.0)).desc(), F.col(unique).asc())
    first = rows.where(F.coalesce(quotable, F.lit(False))).withColumn("cls", F.col(cls)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= texts)
    first = first.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(unique).alias("id")))), lambda x: x["id"]).alias("_ids"))
    j = one.join(first, "cls", "left")
    return j.select("cls", "n", F.col("_m.other").alias("dominant"), F.when(F.col("_known") > 0, -F.col("_m.m") / F.col("_known")).alias("share"), F.array_join("_ids", ",").alias("examples"))


def dominant_label(df: DataFrame, key: str, label: str, weight: Column) -> DataFrame:
    """Per key: the label of most weight (ties to the smaller label), and whether there were several."""
    t = df.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key"), F.col(label).alias("label")).agg(F.sum(F.coalesce(weight, F.lit(0.0))).alias("w"))
    return t.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("_w"), F.col("label").alias("label")))["label"].alias("label"), (F.count("*") > 1).alias("conflict"))


def disagreement_batches(df: DataFrame, unique: str, a: str, b: str, size: int = 15) -> DataFrame:
    """Rows two readers disagree on, by unordered pair of classes in batches of ``size``."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(unique).alias("id"), F.least(a, b).alias("class_a"), F.greatest(a, b).alias("class_b"))
    r = F.row_number().over(Window.partitionBy("class_a", "class_b").orderBy("id"))
    return d.withColumn("batch", F.floor((r - 1) / size).cast("bigint")).select("class_a", "class_b", "batch", "id")


def shards(cards: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Naming cards dealt to ``n`` shards in turn, in the order of their keys; the cards are as many as clusters."""
    return cards.withColumn("shard", ((F.row_number().over(Window.orderBy(key)) - 1) % n).cast("bigint"))


def locator_reach(df: DataFrame, cluster: str, reference: str, least: float = 0.1) -> DataFrame:
    """Share of clusters in which the reference labels ``least`` of the rows or more, the rows in them, and its coverage of rows."""
    c = df.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), F.count(reference).alias("k"))
    solid = F.col("k") >= least * F.col("n")
    return c.agg(
        F.avg(solid.cast("int")).alias("reach"), (F.sum(F.when(solid, F.col("n")).otherwise(0)) / F.sum("n")).alias("mass"), F.sum(solid.cast("long")).alias("clusters_reached"), F.count("*").alias("clusters"), (F.sum("k") / F.sum("n")).alias("row_coverage")
    )


def char_categories(df: DataFrame, text: str) -> DataFrame:
    """Characters of all texts by Unicode general category, most frequent first."""
    names = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Co", "Cs")
    n = {k: F.sum(F.length(F.regexp_replace(text, rf"[^\p{{{k}}}]", ""))).alias(k) for k in names}
    one = df.where(F.col(text).isNotNull()).agg(*n.values(), F.sum(F.length(text)).alias("_all"))
    t = one.select("_all", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("n")) for k in names])).alias("r"))
    return t.select("r.category", "r.n", (F.col("r.n") / F.col("_all")).alias("share")).where("n > 0")


def shared_texts(df: DataFrame, source: str, text: str) -> DataFrame:
    """For each pair of inputs their distinct texts and how many they share; a text is met with its inputs, never inputs with each other."""
    t = df.where(F.col(source).isNotNull() & F.col(text).isNotNull()).groupBy(text).agg(F.array_sort(F.collect_set(source)).alias("s"))  # inputs are files, a short list
    own = t.select(F.explode("s").alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    pairs = t.where(F.size("s") > 1).select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    pairs = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    return pairs.join(own.select(F.col("source").alias("a"), F.col("n").alias("n_a")), "a").join(own.select(F.col("source").alias("b"), F.col("n").alias("n_b")), "b").select("a", "b", "n_a", "n_b", "shared")
