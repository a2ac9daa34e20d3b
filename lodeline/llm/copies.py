"""Copies of records that differ in format alone: canonical form, range sort, run scan.

The canonical form of a text keeps its letters, digits and symbols in order, without
letter case, punctuation, white and invisible characters. A text made up of
``name: value`` fields is the sorted list of its fields, so the order of fields is lost
but not which value belongs to which name.

Records are range-partitioned by (scope, canonical form, id) and sorted within partitions
(Spark's sorter spills to disk); each partition is scanned once as Arrow batches, comparing
full keys of neighbours. The id is part of the range, so copies of one record may be a third
of all rows and still spread over many partitions: what a partition knows of its first and
last run is one line, and these lines (one a partition, with keys of at most ``KEY_BYTES``
or else their length and SHA-256) settle runs that cross a border. The same scan gives each
copy its record and each record its exact number of copies. Keys are made once and written,
as the range needs a sample of them before they are moved.

Null texts, texts without letter, digit or symbol, and rows with a null or NaN in a scope
column are no records. Repeated ids are distinct rows. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: Punctuation, white, invisible and unassigned characters.
IGNORED = r"[\p{P}\p{Z}\p{C}]+"
_FIELD = r"[^:：;；,，\n]+[:：][^:：;；,，\n]+"
_EDGE = r"^[\p{P}\p{Z}\p{C}]+|[\p{P}\p{Z}\p{C}]+$"
FIELDED = rf"^{_FIELD}(?:[;；,，\n]+{_FIELD})+[;；,，\n\s]*$"


def _plain(c: Column) -> Column:
    """Without what is ignored, in lower case; upper case first, so that letters with several small forms meet, sharp s as its capitals."""
    return F.regexp_replace(F.lower(F.upper(F.regexp_replace(c, "[ßẞ]", "ss"))), IGNORED, "")


def canonical(text: Column) -> Column:
    """The canonical form of a text; null for null and for texts without content."""
    trimmed = F.regexp_replace(text, _EDGE, "")
    parts = F.filter(F.split(trimmed, r"[;；,，\n]+"), lambda x: F.length(F.regexp_replace(x, IGNORED, "")) > 0)
    one = lambda x: F.concat(_plain(F.regexp_extract(x, r"^([^:：]*)", 1)), F.lit("\u0001"), _plain(F.regexp_extract(x, r"[:：](.*)$", 1)))
    fields = F.concat(F.lit("\u0002"), F.array_join(F.array_sort(F.transform(parts, one)), "\u0002"))
    form = F.when(trimmed.contains(":") | trimmed.contains("："), F.when(trimmed.rlike(FIELDED), fields).otherwise(_plain(text))).otherwise(_plain(text))
    return F.when(form != "", form)


KEY_BYTES = 256
_FIELDS = [
    ("part", pa.int32()), ("kind", pa.int32()), ("first_row_id", pa.int64()), ("row_id", pa.int64()), ("n", pa.int64()),
    ("first_key", pa.binary()), ("last_key", pa.binary()), ("first_n", pa.int64()), ("last_run", pa.int64()), ("last_n", pa.int64()),
]
_ARROW = pa.schema(_FIELDS)
#: Kinds of lines: a copy; a row of the partition's first run; a run inside the partition; what is known at its borders.
COPY, FIRST, RUN, BORDER = range(4)
_SPARK = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.binary(): T.BinaryType()}
_OUT = T.StructType([T.StructField(n, _SPARK[t]) for n, t in _FIELDS])


def _brief(key: bytes) -> bytes:
    return key if len(key) <= KEY_BYTES else b"%d:" % len(key) + hashlib.sha256(key).digest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: key (binary), row_id, part, sorted. Emits copies, the rows of the first run, runs inside, and one line for the borders."""
    first_key = last_key = None
    first_id = run_id = None
    first_n = run_n = 0
    runs, part = 0, 0

    def lines(**columns) -> pa.RecordBatch:
        n = len(columns["kind"])
        data = [pa.array(np.full(n, part, np.int32)), *[pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _FIELDS[1:]]]
        return pa.RecordBatch.from_arrays(data, schema=_ARROW)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, ids = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        part = batch.column(2)[0].as_py()
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        head = keys[0].as_py()
        if first_key is None:
            first_key, first_id = head, int(ids[0])
        elif head == last_key:
            new[0] = False
        run = np.cumsum(new) + runs  # number of the run, from 1
        starts = np.flatnonzero(new)
        lead = int(starts[0]) if len(starts) else n
        sizes = np.diff(np.append(starts, n))
        firsts = np.empty(n, np.int64)
        firsts[:lead] = run_id or 0
        firsts[lead:] = np.repeat(ids[starts], sizes)
        in_first = run == 1
        keep = ~new | in_first
        if keep.any():
            yield lines(kind=np.where(in_first[keep], FIRST, COPY).astype(np.int32), first_row_id=firsts[keep], row_id=ids[keep])
        # runs that ended here: the one held over, and all started here but the last
        ended_ids, ended_n = ids[starts[:-1]], sizes[:-1]
        if len(starts):
            if runs:
                ended_ids, ended_n = np.r_[run_id, ended_ids], np.r_[run_n + lead, ended_n]
            if runs <= 1 and len(ended_ids):
                first_n, ended_ids, ended_n = int(ended_n[0]), ended_ids[1:], ended_n[1:]
            run_id, run_n = int(ids[starts[-1]]), int(sizes[-1])
        else:
            run_n += n
        if len(ended_ids):
            yield lines(kind=np.full(len(ended_ids), RUN, np.int32), first_row_id=ended_ids.astype(np.int64), n=ended_n.astype(np.int64))
        runs, last_key = int(run[-1]), keys[n - 1].as_py()
    if first_key is not None:
        one = runs == 1
        yield lines(kind=[BORDER], first_row_id=[first_id], n=[runs], first_key=[_brief(first_key)], last_key=[_brief(last_key)], first_n=[run_n if one else first_n], last_run=[run_id], last_n=[run_n])


def _records(df: DataFrame, row_id: str, scope: list[str], text: str) -> DataFrame:
    """(key, row_id) of the rows that are records."""
    ok = F.lit(True)
    kinds = dict(df.dtypes)
    for c in scope:
        ok &= F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            ok &= ~F.isnan(c)
    norm = [F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) if kinds[c] in ("double", "float") else F.col(c) for c in scope]
    key = F.concat_ws("\u0003", *[x.cast("string") for x in norm], F.col("_form"))
    rows = df.where(ok & F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), canonical(F.col(text)).alias("_form"), *scope).where("_form is not null")
    return rows.select(F.encode(key, "utf-8").alias("key"), "row_id")


def _scanned(df: DataFrame, row_id: str, scope: list[str], text: str) -> tuple[DataFrame, list[tuple[int, int]], list[tuple[int, int]]]:
    """Lines of the scan; (part, first id) of first runs that began in an earlier partition; (first id, n) of runs at borders."""
    rows = materialise(_records(df, row_id, scope, text))
    ordered = rows.repartitionByRange("key", "row_id").sortWithinPartitions("key", "row_id").withColumn("part", F.spark_partition_id())
    found = materialise(ordered.mapInArrow(_scan, _OUT))
    moved: list[tuple[int, int]] = []
    whole: list[list[int]] = []
    before = None
    # One line a partition; the number of partitions bounds it, whatever the input.
    for x in found.where(F.col("kind") == BORDER).orderBy("part").collect():
        if before is not None and bytes(x.first_key) == before:
            moved.append((x.part, whole[-1][0]))
            whole[-1][1] += x.first_n
        else:
            whole.append([x.first_row_id, x.first_n])
        if x.n > 1:
            whole.append([x.last_run, x.last_n])
        before = bytes(x.last_key)
    return found, moved, [(a, b) for a, b in whole]


def find_copies(df: DataFrame, row_id: str, scope: list[str], text: str) -> DataFrame:
    """(first_row_id, row_id): each copy but the first with the smallest id of its set.

    Two rows are copies if all ``scope`` columns are equal and the canonical forms of
    ``text`` are. ``row_id`` is a bigint.
    """
    found, moved, _ = _scanned(df, row_id, scope, text)
    fix = F.broadcast(df.sparkSession.createDataFrame(moved, "part int, moved long"))
    copies = found.where(F.col("kind") <= FIRST).join(fix, (F.col("kind") == FIRST) & (found["part"] == fix["part"]), "left")
    return copies.select(F.coalesce("moved", "first_row_id").alias("first_row_id"), "row_id").where("first_row_id <> row_id")


def collapse(df: DataFrame, row_id: str, scope: list[str], text: str) -> DataFrame:
    """One row a set of copies (or a single record): first_row_id and n_copies, the exact number of its rows."""
    found, _, borders = _scanned(df, row_id, scope, text)
    runs = found.where(F.col("kind") == RUN).select("first_row_id", F.col("n").alias("n_copies"))
    return runs.unionByName(df.sparkSession.createDataFrame(borders, "first_row_id long, n_copies long"))
