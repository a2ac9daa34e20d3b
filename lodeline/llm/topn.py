"""The first N rows of every group by secondary sort, without a hot or a buffered group.

Rows are hash-partitioned by group and a salt, sorted within partitions, and streamed as
Arrow batches; at most N rows of a group and salt leave. A second, small round without
the salt settles the places. There are as many salts as the session has shuffle partitions
(``SALTS`` at least), so a group of any size, even a third of all rows, is spread over
all tasks in the first round and has at most N rows a salt in the second.

Ties are settled by the order given, so it should end in a unique column; rows that are
equal in all its columns are ranked in an arbitrary but single order. A null group value
is a group of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 16


def _first_n(groups: int, n: int, places: bool):
    """Keep the first n rows of each run of equal values in the first ``groups`` columns, over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        seen = 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            change = np.zeros(rows, bool)
            change[0] = True
            for i in range(groups):
                c = batch.column(i)
                a, b = c.slice(1), c.slice(0, rows - 1)
                same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
                change[1:] |= ~same
            starts = np.flatnonzero(change)
            place = np.arange(rows) - np.repeat(starts, np.diff(np.append(starts, rows)))
            first = tuple(batch.column(i)[0].as_py() for i in range(groups))
            head = starts[1] if len(starts) > 1 else rows
            if first == last:
                place[:head] += seen
            seen = int(place[-1]) + 1
            last = tuple(batch.column(i)[rows - 1].as_py() for i in range(groups))
            keep = place < n
            if keep.any():
                out = batch.filter(pa.array(keep))
                if places:
                    out = pa.RecordBatch.from_arrays([*out.columns, pa.array(place[keep] + 1, pa.int64())], names=[*out.schema.names, "place"])
                yield out

    return run


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int, keep: list[str]) -> DataFrame:
    """``groups`` + ``keep`` + place (1 to ``n``) of the first ``n`` rows of each group by ``order``.

    ``order`` may use any column of ``groups`` and ``keep``. The salt is a hash of the
    kept columns, so that a rerun of a lost task places every row as before.
    """
    salts = max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    g = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(groups, g)], *keep)
    kept = T.StructType(rows.schema.fields)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*keep), F.lit(salts)).cast("int")).select(*g, "_salt", *keep)
    one = salted.repartition(*g, "_salt").sortWithinPartitions(*g, "_salt", *order)
    one = one.mapInArrow(_first_n(len(g) + 1, n, False), one.schema).drop("_salt")
    two = one.repartition(*g).sortWithinPartitions(*g, *order)
    two = two.mapInArrow(_first_n(len(g), n, True), T.StructType([*kept.fields, T.StructField("place", T.LongType())]))
    return two.select(*[F.col(a).alias(c) for c, a in zip(groups, g)], *keep, "place")


def first_delivery(df: DataFrame, key: str, unique: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: that of the smallest ``unique``. Combined before the shuffle, so a repeated key costs a row a task.

    A null key says nothing about repetition: such rows all stay.
    """
    one = df.groupBy(key, F.when(F.col(key).isNull(), F.col(unique)).alias("_alone")).agg(F.min(F.struct(unique, *columns)).alias("_r"))
    return one.select(key, "_r.*")
