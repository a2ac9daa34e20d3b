"""Class counts over event time as a stream, feeding the same comparisons window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 10) -> DataFrame:
    """A file source of Parquet events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def class_counts(events: DataFrame, at: str, cls: str, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """window_start, cls, n by tumbling (or sliding) windows; rows later than ``late`` behind the newest are dropped by the watermark."""
    w = F.window(F.col(at), window, slide) if slide else F.window(F.col(at), window)
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if timed.isStreaming else timed
    return timed.groupBy(w.alias("w"), F.col(cls).alias("cls")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "cls", "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n by session windows."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if timed.isStreaming else timed
    return timed.groupBy(F.session_window(F.col(at), gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicate(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if timed.isStreaming else timed.dropDuplicates(keys)


def write(stream: DataFrame, path: str, checkpoint: str):
    """Append closed windows as Parquet; with the checkpoint a restart loses and repeats nothing."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
