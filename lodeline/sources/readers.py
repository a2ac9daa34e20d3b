"""Reading inputs: by suffix, tagged by snapshot, pooled over the columns all of them share."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import char_profile
from ..operators.prepare import Refused

TAG_COLUMNS = ("event_day", "date", "dt", "snapshot")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON (an array or lines), ORC, or delimited text with a header; workbooks are refused, as Spark has no reader for them."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".orc":
        return spark.read.orc(path)
    if suffix == ".jsonl":
        return spark.read.json(path)
    if suffix == ".json":
        return spark.read.option("multiLine", True).json(path)
    if suffix in (".xlsx", ".xls"):
        raise Refused(f"{path}: workbooks have no reader here; export the sheet as CSV or Parquet")
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if suffix == ".tsv" else ",").csv(path)


def snapshot_tag(df: DataFrame, path: str) -> str:
    """The value of the first tag column that holds exactly one; else 6 to 8 digits of the file name; else the name. One pass over the file."""
    here = [c for c in TAG_COLUMNS if c in df.columns]
    if here:
        r = df.agg(*[F.min(F.col(c).cast("string")).alias(f"lo_{c}") for c in here], *[F.max(F.col(c).cast("string")).alias(f"hi_{c}") for c in here]).head()
        for c in here:
            if r[f"lo_{c}"] is not None and r[f"lo_{c}"] == r[f"hi_{c}"]:
                return r[f"lo_{c}"]
    stem = PurePosixPath(path.rstrip("/")).stem
    digits = re.search(r"(?<!\d)\d{6,8}(?!\d)", stem)
    return digits.group() if digits else stem


def pool(inputs: list[tuple[str, DataFrame]]) -> tuple[DataFrame, list[str]]:
    """Tagged inputs under one another over the columns they share, and the columns left behind; a tag twice is refused."""
    tags = [t for t, _ in inputs]
    if len(set(tags)) != len(tags):
        raise Refused(f"a snapshot tag occurs twice: {tags}")
    shared = [c for c in inputs[0][1].columns if all(c in df.columns for _, df in inputs) and c != "snapshot"]
    left = sorted({c for _, df in inputs for c in df.columns} - set(shared) - {"snapshot"})
    out = None
    for tag, df in inputs:
        part = df.select(*shared, F.lit(tag).alias("snapshot"))
        out = part if out is None else out.unionByName(part)
    return out, left


def build_frame(df: DataFrame, text: str, weight: str | None = None, snapshot: str | None = None, reference: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """The canonical frame: query, twelve features, weight, snapshot, reference columns and a dense row_id (from 0).

    Dense ids need no global window: rows are range-ordered, counted by partition, and each partition starts at its offset.
    """
    missing = [c for c in (text, *reference) if c not in df.columns]
    if missing:
        raise Refused(f"no such columns: {missing}")
    ordered = df.orderBy(order) if order else df
    cols = [F.col(text).cast("string").alias("query"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), (F.col(snapshot) if snapshot else F.lit(None).cast("string")).alias("snapshot"), *[F.col(c) for c in reference]]
    base = ordered.select(*cols, F.monotonically_increasing_id().alias("_m"))
    base = base.withColumn("_p", F.shiftright("_m", 33))
    from ..session import materialise

    base = materialise(base)
    sizes = base.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = base.join(F.broadcast(starts), "_p").withColumn("row_id", F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.select("row_id", "query", *[c.alias(k) for k, c in char_profile(F.col("query")).items()], "weight", "snapshot", *reference)


def label_like_columns(df: DataFrame, most_share: float = 0.05) -> list[str]:
    """Text columns with 2 to max(2, 5 % of the rows) distinct values; one pass with approximate counts."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return []
    r = df.agg(F.count("*").alias("_rows"), *[F.approx_count_distinct(c, 0.02).alias(c) for c in texts]).head()
    return [c for c in texts if 2 <= r[c] <= max(2, most_share * r["_rows"])]


def verified_join(labels: DataFrame, corpus: DataFrame, unique: str, text: str) -> DataFrame:
    """One to one join on ``unique`` that refuses unless both sides have the same rows with the same text."""
    a, b = labels.withColumnRenamed(text, "_ta"), corpus.select(unique, F.col(text).alias("_tb"), *[c for c in corpus.columns if c not in (unique, text) and c not in labels.columns])
    j = a.join(b, unique, "full_outer")
    n, twice = labels.count(), labels.groupBy(unique).count().where("count > 1").limit(1).count()
    bad = j.where(~F.col("_ta").eqNullSafe(F.col("_tb"))).limit(1).count()
    if twice or bad or n != corpus.count():
        raise Refused("the sides of a verified join differ in rows or in text")
    return j.drop("_tb").withColumnRenamed("_ta", text)


def as_bool(c: str):
    """Booleans written as text in several ways."""
    return F.lower(F.trim(F.col(c).cast("string"))).isin("true", "1", "yes", "是")
