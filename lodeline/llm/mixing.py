"""Mixing sources to target weights by capped water-filling and seeded repetition.

A source can give at most its tokens times its greatest number of repeats. Within a budget
(by default all tokens of the listed sources) sources whose target is above that are clamped
there, and what they leave is shared among the others in proportion to their targets, until
nothing is above its cap. With the budget None the largest total is taken at which every
source that has any tokens reaches its target. An amount is whole repetitions of a source and a seeded part of it: the documents
with the smallest hashes, up to the tokens wanted.

The part is found by two histograms of hashes (``BINS`` a source each), so nothing is sorted
and no source, however large, meets in one task; the driver holds totals by source and bin.

Null sources and sources without a target give nothing. Null and empty texts have no tokens
and are repeated with their source. Repeated rows are documents of their own. An empty table
gives an empty mix; a target without documents is reported with a share of zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a histogram, sources at most, seed of the hashes.
BINS, MAX_SOURCES, SEED = 4096, 1000, 17


@dataclass
class Source:
    name: str
    target: float
    repeats: int
    tokens: int = 0
    amount: float = 0.0  # tokens wanted
    whole: int = 0
    part: float = 0.0


def fill(sources: list[Source], budget: float | None = None) -> list[Source]:
    """Set ``amount``, ``whole`` and ``part`` of each source; amounts never exceed tokens x repeats."""
    for s in sources:
        s.amount = 0.0
    live = [s for s in sources if s.tokens > 0 and s.target > 0 and s.repeats > 0]
    weight = sum(s.target for s in live)
    if live and budget is None:
        budget = min(s.tokens * s.repeats * weight / s.target for s in live)
    rest, open_ = budget or 0.0, list(live)
    while open_:
        weight = sum(s.target for s in open_)
        over = [s for s in open_ if rest * s.target / weight > s.tokens * s.repeats * (1 + 1e-12)]
        for s in over or open_:
            s.amount = float(s.tokens * s.repeats) if over else rest * s.target / weight
        rest -= sum(s.amount for s in over)
        open_ = [s for s in open_ if not any(s is o for o in over)] if over else []
    for s in sources:
        epochs = min(float(s.repeats), s.amount / s.tokens) if s.tokens else 0.0
        s.whole = int(epochs + 1e-9)
        s.part = max(0.0, epochs - s.whole) * s.tokens
        if s.part < 0.5:
            s.part = 0.0
    return sources


def _cut(bins: dict[int, int], want: float) -> tuple[int, float]:
    """The bin in which the running total of tokens passes ``want``, and the tokens before it."""
    run = 0.0
    for b in sorted(bins):
        if run + bins[b] > want:
            return b, run
        run += bins[b]
    return BINS, run


def mix(docs: DataFrame, source: str, tokens: str, unique: str, targets: DataFrame, budget: float | str | None = "all", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents in the mix with ``copies``, report by source).

    ``budget`` is a number of tokens, ``"all"`` for the tokens of all listed sources, or
    None. ``targets`` has source, target_share and max_repeats. The report has source,
    target_share, max_repeats, tokens (of the source once), taken_tokens, taken_docs,
    left_tokens (of the source, in no copy, if less than one repetition is taken), epochs,
    at_cap (the target was out of reach) and actual_share.
    """
    wanted = targets.where("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = {r.source: Source(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in wanted}
    spark = docs.sparkSession
    u = F.xxhash64(F.lit(seed), F.col(source), F.col(unique))
    named = F.broadcast(spark.createDataFrame([(s,) for s in sources] or [("",)], "_s string"))
    rows = docs.join(named, docs[source] == named["_s"], "left_semi")
    rows = rows.withColumn("_b1", F.pmod(u, F.lit(BINS)).cast("int")).withColumn("_b2", F.pmod(F.shiftrightunsigned(u, 12), F.lit(BINS)).cast("int"))
    first: dict[str, dict[int, int]] = {}
    for r in rows.groupBy(source, "_b1").agg(F.sum(tokens).alias("t")).collect():  # at most MAX_SOURCES x BINS
        first.setdefault(r[source], {})[r._b1] = int(r.t or 0)
    for s in sources.values():
        s.tokens = sum(first.get(s.name, {}).values())
    fill(list(sources.values()), float(sum(s.tokens for s in sources.values())) if budget == "all" else budget)
    cuts = {n: _cut(first.get(n, {}), s.part) for n, s in sources.items()}
    edge = spark.createDataFrame([(n, b, s) for n, (b, s) in cuts.items()] or [("", 0, 0.0)], "_s string, _cut int, _run double")
    at_edge = rows.join(F.broadcast(edge), (rows[source] == edge["_s"]) & (rows["_b1"] == edge["_cut"]))
    second: dict[str, dict[int, int]] = {}
    for r in at_edge.groupBy(source, "_b2").agg(F.sum(tokens).alias("t")).collect():
        second.setdefault(r[source], {})[r._b2] = int(r.t or 0)
    plan = []
    for n, s in sources.items():
        fine = _cut(second.get(n, {}), s.part - cuts[n][1])
        size = second.get(n, {}).get(fine[0], 0)
        missing = s.part - cuts[n][1] - fine[1]
        # the bin at the cut (as a rule one document) is taken if the total comes nearer by it
        last = fine[0] + (1 if size and missing > size / 2 else 0) if s.part else 0
        plan.append((n, s.whole, cuts[n][0] if s.part else -1, last))
    chosen = F.broadcast(spark.createDataFrame(plan or [("", 0, -1, 0)], "_s string, _whole int, _cut int, _last int"))
    got = rows.join(chosen, rows[source] == chosen["_s"])
    extra = (F.col("_b1") < F.col("_cut")) | ((F.col("_b1") == F.col("_cut")) & (F.col("_b2") < F.col("_last")))
    got = got.withColumn("copies", F.col("_whole") + extra.cast("int")).where("copies > 0").drop("_s", "_whole", "_cut", "_last", "_b1", "_b2")
    taken = got.groupBy(source).agg(F.sum(F.col(tokens) * F.col("copies")).alias("taken_tokens"), F.sum("copies").alias("taken_docs"))
    have = spark.createDataFrame([(s.name, s.target, s.repeats, s.tokens) for s in sources.values()], "source string, target_share double, max_repeats int, tokens bigint")
    report = have.join(taken.withColumnRenamed(source, "source"), "source", "left").fillna(0, ["taken_tokens", "taken_docs"])
    # a window over at most MAX_SOURCES rows
    report = report.withColumn("_t", F.sum("taken_tokens").over(Window.partitionBy()))
    return got, report.select(
        "source", "target_share", "max_repeats", "tokens", "taken_tokens", "taken_docs",
        F.greatest(F.col("tokens") - F.col("taken_tokens"), F.lit(0)).cast("bigint").alias("left_tokens"),
        (F.col("taken_tokens") >= F.col("tokens") * F.col("max_repeats")).alias("at_cap"),
        F.when(F.col("tokens") > 0, F.col("taken_tokens") / F.col("tokens")).otherwise(0.0).alias("epochs"),
        F.when(F.col("_t") > 0, F.col("taken_tokens") / F.col("_t")).otherwise(0.0).alias("actual_share"),
    )
