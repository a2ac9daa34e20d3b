"""Encoding and decoding of a corpus with a public byte-level BPE tokenizer.

Texts are cut into pre-tokens in the JVM, once, and kept as arrays under a handle of the row;
each distinct pre-token of the corpus is encoded once, and its ids are joined back and put
together by position. The ``COMMON`` most frequent pre-tokens of at most ``SHORT`` characters
(so a bounded table) are put in where the arrays lie; only the others are exploded with their
positions and meet their ids in a shuffle, where a longer one that is frequent is broadcast
(see :func:`lodeline.session.join_aggregate`), so no word is a hot key.

Null and empty texts give an empty list; blank texts are encoded as they are; names of
special tokens in a text are ordinary text. Every input row gives one row, also repeated
ones; texts of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import join_aggregate, materialise

#: Folder of the vocabulary files; they are read where they lie, never copied.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PRE_TOKEN, mergeable_ranks=ranks(path), special_tokens={})


_VOCAB = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [enc.encode_ordinary(w) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return run


#: Pre-tokens put in without a shuffle, and their greatest length.
COMMON, SHORT = 20_000, 32


def _cut(df: DataFrame, text: str) -> DataFrame:
    """The other columns of every row with a handle and the pre-tokens of its text, written once so that handles stay."""
    words = F.regexp_extract_all(text, F.lit("(?U)" + PRE_TOKEN), F.lit(0))
    return materialise(df.select(F.monotonically_increasing_id().alias("_h"), F.coalesce(words, F.array().cast("array<string>")).alias("_words"), *[c for c in df.columns if c != text]))


def _vocabulary(cut: DataFrame, path: str) -> DataFrame:
    """The pre-tokens in use: word, n, ids."""
    counted = cut.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return materialise(counted.mapInArrow(_encode_words(path), _VOCAB))


def _common(vocab: DataFrame) -> dict[str, list[int]]:
    rows = vocab.where(F.length("word") <= SHORT).orderBy(F.col("n").desc(), "word").limit(COMMON).select("word", "ids").collect()
    return {r.word: r.ids for r in rows}


def _put(common: dict[str, list[int]]):
    """Words in the first column become the ids of common words, -1 in place of each other word, and these words in order."""

    hole = [-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = lists.offsets.to_numpy()
            flat = lists.flatten()
            coded = flat.dictionary_encode()  # each distinct word of the batch is looked up once
            code = coded.indices.to_numpy(zero_copy_only=False)
            each = [common.get(w, hole) for w in coded.dictionary.to_pylist()]
            length = np.array([len(e) for e in each], np.int64)
            start = np.cumsum(length) - length
            values = np.array([i for e in each for i in e], np.int32)
            sizes = length[code]
            total = np.r_[0, np.cumsum(sizes)]
            ids = values[np.repeat(start[code] - total[:-1], sizes) + np.arange(total[-1])] if len(code) else np.empty(0, np.int32)
            other = np.array([e is hole for e in each], bool)[code]
            at = ends - ends[0]
            known = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((total[at] * 4).astype(np.int32)), pa.py_buffer(ids)])
            rest = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(other)][at].astype(np.int32)), flat.filter(pa.array(other)))
            yield pa.RecordBatch.from_arrays([known, rest, *batch.columns[1:]], names=["_known", "_rest", *batch.schema.names[1:]])

    return run


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: id, known ids, lists for the holes. Every list of ids is complete."""
    for batch in batches:
        values, sizes = [], []
        for known, each in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ids = np.frombuffer(known, np.int32)
            if each:
                holes = np.flatnonzero(ids == -1)
                parts = np.split(ids, np.sort(np.r_[holes, holes + 1]))
                parts[1::2] = [np.array(e, np.int32) for e in each]
                ids = np.concatenate(parts)
            values.append(ids)
            sizes.append(len(ids))
        flat = pa.array(np.concatenate(values) if values else np.empty(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[batch.schema.names[0], "ids"])


def _rare(cut: DataFrame, vocab: DataFrame, common: dict[str, list[int]]) -> tuple[DataFrame, DataFrame]:
    """Every row with known ids and other words, and (handle, pos, ids) of each of the other words."""
    others = [c for c in cut.schema.fields if c.name != "_words"]
    schema = T.StructType([T.StructField("_known", T.BinaryType()), T.StructField("_rest", T.ArrayType(T.StringType())), *others])
    put = materialise(cut.select("_words", *[c.name for c in others]).mapInArrow(_put(common), schema))
    total = vocab.agg(F.sum("n")).head()[0] or 0
    return put, join_aggregate(put.select("_h", F.posexplode("_rest").alias("pos", "word")), vocab, ["word"], "n", total)


def encode(df: DataFrame, row_id: str, text: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row_id, ids) of every row."""
    cut = _cut(df.select(F.col(row_id).alias("_id"), F.col(text).alias("_text")), "_text")
    vocab = _vocabulary(cut, f"{folder}/{vocabulary}")
    put, rare = _rare(cut, vocab, _common(vocab))
    lists = rare.groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("_each"))
    lists = lists.select("_h", F.transform("_each", lambda x: x["ids"]).alias("_each"))
    whole = put.select("_h", "_id", "_known").join(lists, "_h", "left").select(F.col("_id").alias(row_id), "_known", "_each")
    return whole.mapInArrow(_fill, T.StructType([T.StructField(row_id, df.schema[row_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def count(df: DataFrame, text: str, out: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The other columns of every row of ``df`` with ``out``, the number of tokens of ``text`` (0 for null and empty ones)."""
    cut = _cut(df, text)
    vocab = _vocabulary(cut, f"{folder}/{vocabulary}")
    put, rare = _rare(cut, vocab, _common(vocab))
    more = rare.groupBy("_h").agg(F.sum(F.size("ids")).alias("_more"))
    known = F.length("_known") / 4 - F.size("_rest")
    columns = [c for c in df.columns if c != text]
    return put.join(more, "_h", "left").select(*columns, (known + F.coalesce("_more", F.lit(0))).cast("bigint").alias(out))


def token_bytes(spark: SparkSession, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The token-byte table: (id, bytes in hex), as many rows as the vocabulary has ids."""
    return spark.createDataFrame([(i, b.hex()) for b, i in ranks(f"{folder}/{vocabulary}").items()], "id int, hex string")


def decode(df: DataFrame, row_id: str, ids: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row_id, text) of every row, by a join with the token-byte table; null ids give an empty text."""
    rows = df.select(F.monotonically_increasing_id().alias("_h"), F.col(row_id).alias("_id"), F.col(ids).alias("_ids"))
    table = F.broadcast(token_bytes(df.sparkSession, folder, vocabulary))  # bounded by the vocabulary file
    parts = rows.select("_h", "_id", F.posexplode_outer("_ids").alias("pos", "id")).join(table, "id", "left")
    lists = parts.groupBy("_h", "_id").agg(F.array_sort(F.collect_list(F.struct("pos", "hex"))).alias("each"))
    return lists.select(F.col("_id").alias(row_id), F.decode(F.unhex(F.array_join(F.transform("each", lambda x: x["hex"]), "")), "utf-8").alias("text"))
