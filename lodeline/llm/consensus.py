"""Consensus of several annotators by a competence-and-spamming mixture.

Each label is either truthful, with the annotator's competence as its probability, or
drawn from the annotator's personal guess distribution. Expectation-maximisation over
all items yields a posterior over the classes per item and competence and guess
distribution per annotator.

The labels of an item are packed into one short value once; every iteration is one pass of
Arrow batches over these, and only expected counts (annotators x classes) are shuffled,
combined in each task first. The parameters held by the driver are bounded by
``MAX_ANNOTATORS``; beyond that the operator refuses.

Null items, null annotators and unreadable codes are no labels; of one annotator's
labels of an item the latest holds, ties by the larger id; labels sent twice count once.
Items without any label get a null class. Empty tables give empty results. Ties between
classes go to the smaller code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

MAX_ANNOTATORS = 65_536
ITERATIONS, TOLERANCE = 40, 1e-4
#: Pseudo-counts of competence (truthful, guessed), of guesses and of classes.
COMPETENCE, GUESS, CLASS = (1.0, 1.0), 0.1, 1.0


@dataclass
class Mixture:
    """Fitted parameters: competence per annotator, guesses (annotator x class), shares of the classes."""

    annotators: list[str]
    classes: int
    competence: np.ndarray
    guesses: np.ndarray
    prior: np.ndarray
    n_labels: np.ndarray

    def posterior(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item x class posterior, item of each label, annotator, class)."""
        lengths = np.array([len(b) // 3 for b in packed], np.int64)
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 3)
        who, what = raw[:, 0].astype(np.int64) * 256 + raw[:, 1], raw[:, 2].astype(np.int64)
        item = np.repeat(np.arange(len(packed)), lengths)
        t, g = self.competence[who], self.guesses[who, what]
        gain = np.log1p(t / ((1 - t) * g))
        score = np.bincount(item * self.classes + what, gain, len(packed) * self.classes).reshape(-1, self.classes) + np.log(self.prior)
        score -= score.max(1, keepdims=True)
        q = np.exp(score)
        return q / q.sum(1, keepdims=True), item, who, what


def latest(votes: DataFrame, item: str, annotator: str, code: str, at: str, tie: str) -> DataFrame:
    """(item, annotator, code) of the latest vote of each annotator on an item; combined before the shuffle."""
    votes = votes.where(F.col(item).isNotNull() & F.col(annotator).isNotNull() & F.col(code).isNotNull())
    last = votes.groupBy(F.col(item).alias("item"), F.col(annotator).alias("annotator")).agg(F.max(F.struct(at, tie, code)).alias("v"))
    return last.select("item", "annotator", F.col(f"v.{code}").alias("code"))


def pack(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """(item, labels) with the labels of each item packed, three bytes each; and the annotators in order."""
    counted = labels.groupBy("annotator").count().limit(MAX_ANNOTATORS + 1).collect()
    if len(counted) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    names = sorted(r.annotator for r in counted)
    index = labels.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "annotator string, a int")
    with_index = labels.join(F.broadcast(index), "annotator")  # at most MAX_ANNOTATORS rows
    one = F.unhex(F.concat(F.lpad(F.hex("a"), 4, "0"), F.lpad(F.hex("code"), 2, "0")))
    packed = with_index.groupBy("item").agg(F.array_sort(F.collect_list(one)).alias("each"))
    return packed.select("item", F.aggregate("each", F.unhex(F.lit("")), lambda a, b: F.concat(a, b)).alias("labels")), names


_COUNTS = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("s", T.DoubleType())])


def _expect(m: Mixture):
    """Expected guesses by (annotator, class), and by (-1, class) the expected items of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guessed = np.zeros(len(m.annotators) * m.classes)
        share = np.zeros(m.classes)
        for batch in batches:
            if batch.num_rows:
                q, item, who, what = m.posterior(batch.column(0).to_pylist())
                t, g = m.competence[who], m.guesses[who, what]
                truthful = q[item, what] * t / (t + (1 - t) * g)
                guessed += np.bincount(who * m.classes + what, 1 - truthful, len(guessed))
                share += q.sum(0)
        at = np.flatnonzero(guessed)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([at // m.classes, np.full(m.classes, -1)]).astype(np.int32)),
                pa.array(np.concatenate([at % m.classes, np.arange(m.classes)]).astype(np.int32)),
                pa.array(np.concatenate([guessed[at], share])),
            ],
            names=["a", "k", "s"],
        )

    return run


def fit(packed: DataFrame, names: list[str], classes: int) -> Mixture:
    """Expectation-maximisation until no competence moves by ``TOLERANCE`` or ``ITERATIONS`` are done."""
    n = max(1, len(names))
    m = Mixture(names, classes, np.full(n, 0.7), np.full((n, classes), 1 / classes), np.full(classes, 1 / classes), np.zeros(n))
    width = F.length("labels") / 3
    place = lambda i, j: F.conv(F.hex(F.substring("labels", i, j)), 16, 10).cast("int")
    each = packed.select(F.explode(F.sequence(F.lit(0), (width - 1).cast("int"))).alias("i"), "labels").select(place(F.col("i") * 3 + 1, F.lit(2)).alias("a"))
    for r in each.groupBy("a").count().collect():  # one row an annotator
        m.n_labels[r.a] = r["count"]
    for _ in range(ITERATIONS):
        got = packed.select("labels").mapInArrow(_expect(m), _COUNTS).groupBy("a", "k").agg(F.sum("s").alias("s")).collect()
        guessed, share = np.zeros((n, classes)), np.zeros(classes)
        for a, k, s in got:
            if a < 0:
                share[k] = s
            else:
                guessed[a, k] = s
        before = m.competence
        m.competence = np.clip((m.n_labels - guessed.sum(1) + COMPETENCE[0]) / (m.n_labels + sum(COMPETENCE)), 1e-4, 1 - 1e-4)
        m.guesses = (guessed + GUESS) / (guessed + GUESS).sum(1, keepdims=True)
        m.prior = (share + CLASS) / (share.sum() + classes * CLASS)
        if np.abs(m.competence - before).max() < TOLERANCE:
            break
    return m


_RESULT = T.StructType([T.StructField("item", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("agreement", T.DoubleType()), T.StructField("n_labels", T.IntegerType())])


def decide(packed: DataFrame, m: Mixture) -> DataFrame:
    """Per item: label (its number), confidence (posterior), agreement (share of agreeing pairs of labels; null below two), n_labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, item, _, what = m.posterior(batch.column(1).to_pylist())
            n = np.bincount(item, minlength=len(q))
            c = np.bincount(item * m.classes + what, minlength=len(q) * m.classes).reshape(len(q), -1)
            pairs = n * (n - 1)
            agree = np.where(pairs > 0, (c * (c - 1)).sum(1) / np.maximum(pairs, 1), np.nan)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q.argmax(1).astype(np.int32)), pa.array(q.max(1)), pa.array(agree, from_pandas=True), pa.array(n.astype(np.int32))], names=_RESULT.names)

    return packed.select(F.col("item").cast("bigint"), "labels").mapInArrow(run, _RESULT)


def reliability(m: Mixture, df: DataFrame, names: list[str]) -> DataFrame:
    """Per annotator: n_labels, competence, the class guessed most and its share among the guesses."""
    rows = [(a, int(m.n_labels[i]), float(m.competence[i]), names[int(m.guesses[i].argmax())], float(m.guesses[i].max())) for i, a in enumerate(m.annotators)]
    return df.sparkSession.createDataFrame(rows, "annotator string, n_labels bigint, competence double, guess string, guess_share double")


# ---------------------------------------------------------------------------- codes U01 to U13

CLASSES = 13


def read_code(c: Column) -> Column:
    """The number (0 to 12) of a U code in any spelling; null where it cannot be read or does not exist."""
    n = F.regexp_extract(F.upper(F.trim(c)), r"^U\s*0*([0-9]{1,2})$", 1)
    k = F.when(n != "", n.cast("int"))
    return F.when(k.between(1, CLASSES), k - 1)


def u_code(k: Column) -> Column:
    return F.concat(F.lit("U"), F.lpad((k + 1).cast("string"), 2, "0"))


def all_labels(votes: DataFrame, main: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(item, annotator, code) of every row, by people and by the three labellers of the main table."""
    people = latest(votes.select("row_id", "annotator", read_code(F.col("u_code")).alias("code"), "voted_at", "vote_id"), "row_id", "annotator", "code", "voted_at", "vote_id")
    walk = F.broadcast(crosswalk.select(F.upper(F.trim("own_code")).alias("_own"), read_code(F.col("u_code")).alias("_code")))  # a fixed table of codes
    m = main.where("row_id is not null").select(F.col("row_id").alias("item"), "u_ds", "u_qw", F.upper(F.trim("own_code")).alias("_own")).join(walk, "_own", "left")
    machine = m.select("item", F.explode(F.array(*[F.struct(F.lit(f"labeller:{n}").alias("annotator"), c.alias("code")) for n, c in (("u_ds", read_code(F.col("u_ds"))), ("u_qw", read_code(F.col("u_qw"))), ("own_code", F.col("_code")))])).alias("l")).select("item", "l.annotator", "l.code")
    return people.unionByName(machine.where("code is not null"))


def solve(votes: DataFrame, main: DataFrame, crosswalk: DataFrame) -> tuple[DataFrame, Mixture]:
    """Packed labels of every labelled row and the mixture fitted on all of them."""
    labels = materialise(all_labels(votes, main, crosswalk))
    packed, names = pack(labels)
    packed = materialise(packed)
    return packed, fit(packed, names, CLASSES)


def _report(rows: DataFrame, votes: DataFrame, main: DataFrame, crosswalk: DataFrame) -> DataFrame:
    packed, m = solve(votes, main, crosswalk)
    done = decide(packed, m)
    return rows.join(done.withColumnRenamed("item", "row_id"), "row_id", "left").select("row_id", u_code(F.col("label")).alias("u_code"), "confidence", "agreement", F.coalesce("n_labels", F.lit(0)).alias("n_labels"))


def judge(votes: DataFrame, main: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Per row of the main table or of the votes: row_id, u_code, confidence, agreement, n_labels."""
    return _report(main.select("row_id").unionByName(votes.select("row_id")).where("row_id is not null").distinct(), votes, main, crosswalk)


def found(votes: DataFrame, main: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """What :func:`judge` says, for voted rows alone."""
    return _report(votes.where("row_id is not null").select("row_id").distinct(), votes, main, crosswalk)
