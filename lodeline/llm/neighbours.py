"""The k most similar vectors of every vector, by collision counting on sorted projections.

``tables_for`` times, a vector is rotated and projected on a grid of directions, each the sum
of one of ``side`` directions of each of ``PARTS`` parts of the space, so many directions cost
little. Of each grid a vector keeps the ``KEPT`` directions on which it reaches farthest (the
best of the whole grid, not of a part of it). The vectors that keep a direction form its list,
a single-projection array sorted by value. Around each entry a window is opened in its list;
two vectors whose values lie within it collide in that grid. Windows are those of the radii
``RADII`` and of the similarity asked for: a collision carries the smallest radius it counts
for. Collisions are counted over the grids, and only pairs that collide in at least
``THRESHOLD`` grids are verified by their exact cosine. First the pairs that do so within the
smallest radius; a query that then has k neighbours within that radius is done, for the others
the windows are rehashed to the next one. Vectors travel once to the first step and then only
with pairs to be verified; entries and collisions are numbers.

Collisions are packed by hash of the pair, so that no vector, list or direction is a hot key
of the count. ``side`` grows with the cube root of the number of vectors, so that the lists
keep their length. A list of any length is scanned as a stream that holds one window of it.
What is quadratic: different vectors all within one window of each other (a knot) collide
pair by pair.

Of vectors of one direction (whatever their lengths) the first ``k + 3`` by id of each of
``SALTS`` parts stand for themselves, which always includes the k + 1 smallest ids. The rest
follow the first of their part: their neighbours are the smallest ids of the direction, at a
similarity of 1. As a neighbour a follower is never needed, as smaller ids have its direction
(up to the noise of the floats: below 10^-7 of a cosine for vectors that differ in length).

Vectors that are null, zero, of another length or hold NaN or infinity neither have nor are
neighbours. Repeated ids are not told apart. Ties go to the smaller id. An empty table gives
an empty result. Measured recall is in the README; ``p5_recall`` measures it again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: Parts of the space, directions kept of a grid, grids in which a pair must collide to be verified, directions of a grid per vector.
PARTS, KEPT, THRESHOLD, DIRECTIONS = 3, 6, 2, 2.8
#: Parts of the vectors of one direction.
SALTS = 64
#: Halves of a window, in units of the radius: the difference of a projection is normal with the distance as deviation.
WINDOW = 3.0
#: Cosines of the radii before that of the similarity asked for.
RADII = (0.95,)
#: Collisions held by a task before they are sent, vectors per bucket of the count.
HELD, PER_BUCKET = 2_000_000, 2_000
SEED = 20240711


def parts_for(dim: int) -> int:
    return max(1, min(PARTS, dim))


def side_for(n: int, parts: int) -> int:
    return max(2, math.ceil((DIRECTIONS * max(n, 1)) ** (1 / parts)))


def tables_for(n: int) -> int:
    """12 grids up to 100,000 vectors; more beyond, as close vectors share a direction the less often the more there are."""
    return max(12, math.ceil(12 * (n / 100_000) ** 0.11)) if n else 12


def _grids(dim: int, side: int, tables: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    g = np.random.default_rng(SEED)
    cut = np.linspace(0, dim, parts_for(dim) + 1).astype(int)
    out = []
    for _ in range(tables):
        turn = np.linalg.qr(g.normal(size=(dim, dim)))[0]
        ways = [g.normal(size=(b - a, side)) for a, b in zip(cut, cut[1:])]
        out.append((turn.astype(np.float32), [(w / np.linalg.norm(w, axis=0)).astype(np.float32) for w in ways]))
    return out


_ENTRY = T.StructType([T.StructField("list", T.LongType()), T.StructField("value", T.FloatType()), T.StructField("id", T.LongType())])


def _binary(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _project(dim: int, side: int, tables: int):
    """The entries of each vector: one for every direction it keeps."""
    parts = parts_for(dim)
    cut = np.linspace(0, dim, parts + 1).astype(int)
    most = min(KEPT, side)
    # the KEPT greatest sums are among those of ranks whose product is at most KEPT
    ranks = np.array([c for c in product(range(most), repeat=parts) if math.prod(i + 1 for i in c) <= KEPT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = _grids(dim, side, tables)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                n = batch.num_rows
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                x = _unit(_matrix(batch.column(1), dim)).astype(np.float32)
                for k, (turn, ways) in enumerate(grids):
                    y = x @ turn
                    total, code = np.zeros((n, len(ranks)), np.float32), np.full((n, len(ranks)), k, np.int64)
                    for p, way in enumerate(ways):
                        s = y[:, cut[p] : cut[p + 1]] @ way
                        top = np.argpartition(s, side - most, 1)[:, side - most :]
                        v = np.take_along_axis(s, top, 1)
                        order = np.argsort(-v, 1)
                        total += np.take_along_axis(v, order, 1)[:, ranks[:, p]]
                        code = code * side + np.take_along_axis(top, order, 1)[:, ranks[:, p]]
                    kept = min(KEPT, len(ranks))
                    best = np.argpartition(total, len(ranks) - kept, 1)[:, len(ranks) - kept :]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.take_along_axis(code, best, 1).ravel()), pa.array(np.take_along_axis(total, best, 1).ravel()), pa.array(np.repeat(ids, kept))], names=_ENTRY.names
                    )

    return run


# ---------------------------------------------------------------------------- collisions

_PACK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("pairs", T.BinaryType())])
_CANDIDATE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("level", T.IntegerType())])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _pack(a: np.ndarray, b: np.ndarray, mark: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Collisions as one compressed value a bucket."""
    where = (_mix(a, b) >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(where.astype(np.uint16), kind="stable") if buckets <= 65536 else np.argsort(where, kind="stable")
    a, b, mark, where = a[order], b[order], mark[order], where[order]
    starts = np.r_[0, np.flatnonzero(np.diff(where)) + 1, len(where)]
    codec = pa.Codec("zstd")
    out = []
    for s, e in zip(starts, starts[1:]):
        # bytes of one place together, so that the upper ones vanish in the compression
        planes = np.stack([a[s:e], b[s:e]]).view(np.uint8).reshape(2, e - s, 8).transpose(0, 2, 1)
        out.append(codec.compress(planes.tobytes() + mark[s:e].tobytes(), asbytes=True))
    yield pa.RecordBatch.from_arrays([pa.array(where[starts[:-1]].astype(np.int32)), pa.array(np.diff(starts).astype(np.int32)), pa.array(out, pa.binary())], names=_PACK.names)


def _unpack(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(packed, n * 17), np.uint8)
    both = np.ascontiguousarray(raw[: n * 16].reshape(2, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(2, n)
    return both[0], both[1], raw[n * 16 :]


def _collide(widths: list[float], per_grid: int, buckets: int):
    """Collisions of entries sorted by list and value; what is held over from a batch is one window of its last list."""
    widest = np.float32(widths[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        lists, value, ids = np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64)
        for batch in batches:
            old = len(lists)
            lists, value, ids = (np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate((lists, value, ids)))
            if not len(lists):
                continue
            i, d = np.arange(len(lists)), 0
            while len(i):
                d += 1
                i = i[i + d < len(lists)]
                gap = value[i + d] - value[i]
                near = (lists[i] == lists[i + d]) & (gap <= widest)
                i, gap = i[near], gap[near]
                new = i + d >= old  # pairs of held entries were met before
                j, g = i[new], gap[new]
                if len(j):
                    x, y = ids[j], ids[j + d]
                    level = np.searchsorted(widths[:-1], g).astype(np.uint8) if len(widths) > 1 else np.zeros(len(j), np.uint8)
                    mark = ((lists[j] // per_grid).astype(np.uint8) << 1) | level
                    held.append((np.minimum(x, y), np.maximum(x, y), mark))
                    size += len(j)
                if size >= HELD:
                    yield from _pack(*(np.concatenate(c) for c in zip(*held)), buckets)
                    held, size = [], 0
            keep = (lists == lists[-1]) & (value >= value[-1] - widest)
            lists, value, ids = lists[keep], value[keep], ids[keep]
        if held:
            yield from _pack(*(np.concatenate(c) for c in zip(*held)), buckets)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that collide in ``THRESHOLD`` grids or more, with the number of the radius from which they do; rows arrive by bucket."""
    bucket, parts = None, []

    def close() -> pa.RecordBatch:
        a, b, mark = (np.concatenate(c) for c in zip(*parts))
        # grid and radius in the lowest bits: collisions of a pair lie together, by grid and then radius
        order = np.argsort((_mix(a, b) & ~np.uint64(255)) | mark)
        a, b, mark = a[order], b[order], mark[order]
        pair = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        first = pair | np.r_[True, (mark[1:] >> 1) != (mark[:-1] >> 1)]  # once a grid, at its smallest radius
        at = np.flatnonzero(pair)
        grids = np.add.reduceat(first.astype(np.int32), at)
        small = np.add.reduceat((first & (mark & 1 == 0)).astype(np.int32), at)
        keep = grids >= THRESHOLD
        return pa.RecordBatch.from_arrays([pa.array(a[at][keep]), pa.array(b[at][keep]), pa.array((small[keep] < THRESHOLD).astype(np.int32))], names=_CANDIDATE.names)

    for batch in batches:
        for k, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if k != bucket and parts:
                yield close()
                parts = []
            bucket = k
            parts.append(_unpack(n, packed))
    if parts:
        yield close()


# ---------------------------------------------------------------------------- vectors

_VECTOR = T.StructType([T.StructField("id", T.LongType()), T.StructField("leader", T.LongType()), T.StructField("vec", T.BinaryType())])


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of floats as bytes (minus zero as zero), with a number for their direction."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) + np.float32(0)  # all are of one length
        steps = np.rint(_unit(raw) * 2**17).astype(np.int64).view(np.uint64)
        odd = np.random.default_rng(SEED).integers(1, 2**63, raw.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        mixed = steps * odd
        mixed ^= mixed >> np.uint64(31)
        same = (mixed * odd[::-1]).sum(1, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), _binary(raw)], names=["id", "same", "vec"])


def _lead(stand: int):
    """Rows arrive by direction, part and id: beyond the first ``stand`` of a run they follow its first and need no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader, seen = None, None, 0
        for batch in batches:
            leaders, vecs = [], []
            for same, salt, i, vec in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if (same, salt) != key:
                    key, leader, seen = (same, salt), i, 0
                seen += 1
                leaders.append(None if seen <= stand else leader)
                vecs.append(vec if seen <= stand else None)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(leaders, pa.int64()), pa.array(vecs, pa.binary())], names=_VECTOR.names)

    return run


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])


def _verify(dim: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                exact = np.round(np.einsum("ij,ij->i", _unit(_matrix(batch.column(2), dim)), _unit(_matrix(batch.column(3), dim))), 6)
                keep = pa.array(exact >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(exact).filter(keep)], names=_PAIR.names)

    return run


def usable(df: DataFrame, vec_id: str, vec: str, dim: int) -> DataFrame:
    """(id, vec) of the vectors that take part."""
    good = df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("vec"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)
    return good.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == dim) & F.forall("vec", number) & F.exists("vec", lambda x: x != 0))


def similar(df: DataFrame, vec_id: str, vec: str, dim: int, k: int, least: float) -> DataFrame:
    """(vec_id, place, nn_vec_id, similarity): up to ``k`` others with a cosine, rounded to six decimals, of at least ``least``."""
    rows = usable(df, vec_id, vec, dim).mapInArrow(_directions, "id bigint, same bigint, vec binary")
    rows = rows.select("same", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), "id", "vec")
    rows = rows.repartition("same", "salt").sortWithinPartitions("same", "salt", "id")
    vectors = materialise(rows.mapInArrow(_lead(k + 3), _VECTOR))
    heads = vectors.where("leader is null").select("id", "vec")
    n = heads.count()
    parts, tables = parts_for(dim), tables_for(n)
    side = side_for(n, parts)
    # a direction of a grid has the length sqrt(parts); a projection of a distance r on it deviates by r * sqrt(parts / dim)
    radii = [c for c in RADII if c > least] + [least]
    widths = [WINDOW * math.sqrt(max(0.0, 2 - 2 * c) * parts / dim) for c in radii]
    buckets = max(1, n // PER_BUCKET)
    entries = heads.mapInArrow(_project(dim, side, tables), _ENTRY)
    packs = entries.repartition("list").sortWithinPartitions("list", "value").mapInArrow(_collide(widths, side**parts, buckets), _PACK)
    counted = materialise(packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, _CANDIDATE))
    found, done = None, None
    for level, cosine in enumerate(radii):
        pairs = counted.where(F.col("level") == level).select("a", "b")
        if done is not None:  # only what a query that is not done still asks for
            pairs = pairs.join(done.select(F.col("a"), F.lit(True).alias("_a")), "a", "left").join(done.select(F.col("a").alias("b"), F.lit(True).alias("_b")), "b", "left")
            pairs = pairs.where("_a is null or _b is null").select("a", "b")
        both = pairs.join(heads.select(F.col("id").alias("b"), F.col("vec").alias("y")), "b").join(heads.select(F.col("id").alias("a"), F.col("vec").alias("x")), "a")
        here = materialise(both.select("a", "b", "x", "y").mapInArrow(_verify(dim, least), _PAIR))
        found = here if found is None else found.unionByName(here)
        if level < len(radii) - 1:
            near = here.where(F.col("similarity") >= cosine)
            done = near.select("a").unionByName(near.select(F.col("b").alias("a"))).groupBy("a").count().where(F.col("count") >= k)
    hits = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    w = Window.partitionBy("a").orderBy(F.col("similarity").desc(), F.col("b").asc())
    best = hits.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)
    # followers: the smallest ids among their leader and the neighbours of the leader, all of their direction
    followers = vectors.where("leader is not null").select("id", "leader")
    if followers.isEmpty():
        lists = best
    else:
        best = materialise(best)
        leads = best.join(followers.select(F.col("leader").alias("a")).distinct(), "a", "left_semi").where("similarity = 1")
        smallest = leads.groupBy("a").agg(F.slice(F.array_sort(F.concat(F.collect_set("b"), F.array(F.first("a")))), 1, k).alias("each"))
        own = followers.join(smallest.withColumnRenamed("a", "leader"), "leader").select(F.col("id").alias("a"), F.posexplode("each").alias("place", "b"))
        lists = best.unionByName(own.select("a", "b", F.lit(1.0).alias("similarity"), (F.col("place") + 1).cast("bigint").alias("place")))
    return lists.select(F.col("a").alias(vec_id), "place", F.col("b").alias(f"nn_{vec_id}"), "similarity")


# ---------------------------------------------------------------------------- recall


def _best(dim: int, k: int, least: float):
    """Exact lists of a block of queries within a block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, ids, vecs in zip(*(batch.column(c).to_pylist() for c in range(4))):
                qi, ids = np.array(qi), np.array(ids)
                q, x = (_unit(np.frombuffer(b"".join(v), np.float32).reshape(-1, dim)) for v in (qv, vecs))
                a, b = np.nonzero((q @ x.T >= least - 1e-5) & (qi[:, None] != ids[None]))
                cosine = np.round(np.einsum("ij,ij->i", q[a], x[b]), 6)
                order = np.lexsort((ids[b], -cosine, a))
                a, b, cosine = a[order], b[order], cosine[order]
                start = np.r_[0, np.flatnonzero(np.diff(a)) + 1] if len(a) else np.empty(0, int)
                place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
                keep = (place < k) & (cosine >= least)
                yield pa.RecordBatch.from_arrays([pa.array(qi[a[keep]], pa.int64()), pa.array(ids[b[keep]], pa.int64()), pa.array(cosine[keep])], names=_PAIR.names)

    return run


def exact_lists(df: DataFrame, vec_id: str, vec: str, dim: int, k: int, least: float, block: int = 4096) -> DataFrame:
    """What :func:`similar` should give, for the vectors whose id is divisible by 20, against all, in blocks."""
    packed = usable(df, vec_id, vec, dim).mapInArrow(_directions, "id bigint, same bigint, vec binary").select("id", "vec")
    packed = materialise(packed.repartition(F.expr("id")))
    n = packed.count()
    blocks = max(1, n // block)
    asked = max(1, n // 20 // block)
    rows = packed.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("_block").agg(F.collect_list(F.struct("id", "vec")).alias("v"))
    rows = rows.select(F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("_ask"), F.col("v.id").alias("ids"), F.col("v.vec").alias("vecs"))
    queries = packed.where("id % 20 = 0").withColumn("_ask", F.pmod(F.xxhash64("id"), F.lit(asked)).cast("int")).groupBy("_ask").agg(F.collect_list(F.struct("id", "vec")).alias("q"))
    pairs = rows.join(queries, "_ask").select("q.id", "q.vec", "ids", "vecs").toDF("qi", "qv", "ids", "vecs").repartition(max(1, blocks)).mapInArrow(_best(dim, k, least), _PAIR)
    w = Window.partitionBy("a").orderBy(F.col("similarity").desc(), F.col("b").asc())
    return pairs.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k).select(F.col("a").alias(vec_id), "place", F.col("b").alias(f"nn_{vec_id}"), "similarity")
