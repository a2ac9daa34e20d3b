"""Session helpers: table access, shared-folder materialisation and skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for cut lineage.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset (tests, a
    single machine) a temporary folder is made and kept for the session.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodeline-"))
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete what :func:`materialise` wrote in this process, once no result that reads it is needed; the number of folders deleted."""
    jvm, done = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return done


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Unlike a cached frame the files survive the loss of any executor, and unlike an
    RDD checkpoint they are columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeline-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds this share of all rows or, in very large inputs, more rows than a task should join; there are at most ``HOT_KEYS`` of them.
HOT_SHARE, TASK_ROWS, HOT_KEYS = 0.001, 5_000_000, 20_000


def join_aggregate(rows: DataFrame, agg: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``agg`` (one row a key, ``count`` rows each) without a hot task.

    Keys holding ``HOT_SHARE`` of the ``total`` rows or more than ``TASK_ROWS`` of them
    number at most ``HOT_KEYS``, so their side is broadcast whatever the input is; all
    other keys meet in a shuffle join where no key can dominate a task.
    """
    limit = max(1.0, total / HOT_KEYS, min(total * HOT_SHARE, TASK_ROWS))
    hot = F.broadcast(agg.where(F.col(count) >= limit).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot.select(*keys, "_hot"), keys, "left")
    cool = marked.where("_hot is null").drop("_hot").join(agg.where(F.col(count) < limit), keys, how)
    warm = marked.where("_hot").drop("_hot").join(hot.drop("_hot"), keys, "inner")
    return cool.unionByName(warm)


def running_before(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over all rows before in ``order``, without a window in one task.

    Rows are range-partitioned, each partition runs its own sum, and the sums of whole
    partitions (one line each) are added.
    """
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    total, offsets = 0, []
    for p, s in parts.groupBy("_part").agg(F.sum(value)).orderBy("_part").collect():  # one line a partition
        offsets.append((p, total))
        total += s or 0
    lines = F.broadcast(df.sparkSession.createDataFrame(offsets, f"_part int, _off {dict(df.dtypes)[value]}"))
    return parts.join(lines, "_part").withColumn(out, F.col("_off") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_part", "_off")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
