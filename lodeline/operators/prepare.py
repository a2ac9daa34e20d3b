"""Corpus preparation: a closed set of operations that tier rows and never delete them.

A row keeps its text as read (``query_raw``), gets ``tier`` (``user`` while kept),
``wrapper_stripped`` and ``pv_raw``. A removal that would hit more than a given share of the
rows is refused: it becomes a flag. Counts of an operation come from one aggregate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_aggregate, running_before

from ..functions.stats import positive
from ..functions.text import has_content, strip

MAX_DROP_SHARE, HEAD_COVERAGE, WEIGHT_TOTAL = 0.25, 0.9, 10_000.0
OPERATIONS = ("trim", "drop_empty", "drop_duplicates", "length_filter", "strip_prefix", "flag_regex", "drop_regex", "head_cut", "aggregate_by_query", "merge_collisions")
BOUNDED = ("length_filter", "drop_regex")


class Refused(ValueError):
    """What a contract of the engine does not allow."""


@dataclass
class Report:
    """What operations did: (operation, tier, rows hit) and refusals (operation, tier, share)."""

    hits: list[tuple[str, str, int]] = field(default_factory=list)
    refusals: list[tuple[str, str, float]] = field(default_factory=list)


def start(df: DataFrame, text: str, order: str, weight: str | None = None) -> DataFrame:
    """The columns every operation expects; ``row_ord`` is the order of the file."""
    w = F.col(weight).cast("double") if weight else F.lit(None).cast("double")
    keep = [F.col(c) for c in df.columns if c not in (text, "query", "query_raw", "wrapper_stripped", "tier", "pv_raw", "row_ord")]
    return df.select(*keep, F.col(text).cast("string").alias("query"), F.col(text).cast("string").alias("query_raw"), F.lit(False).alias("wrapper_stripped"), F.lit("user").alias("tier"), w.alias("pv_raw"), F.col(order).alias("row_ord"))


def _tiered(df: DataFrame, hit: Column, tier: str) -> DataFrame:
    return df.withColumn("tier", F.when((F.col("tier") == "user") & F.coalesce(hit, F.lit(False)), tier).otherwise(F.col("tier")))


def trim(df: DataFrame) -> DataFrame:
    return df.withColumn("query", strip(F.col("query")))


def drop_empty(df: DataFrame, tier: str = "drop_empty") -> DataFrame:
    return _tiered(df, ~has_content(F.col("query")), tier)


def drop_duplicates(df: DataFrame, tier: str = "drop_duplicates") -> DataFrame:
    """Every occurrence of a text but the first in file order.

    The first is found by an aggregate that is combined before its shuffle, so a text that
    fills a third of the rows is no hot window.
    """
    firsts = df.groupBy("query").agg(F.min("row_ord").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and query is not null")
    j = join_aggregate(df, firsts, ["query"], "_n", df.count(), "left")
    return _tiered(j, F.col("_first").isNotNull() & (F.col("row_ord") != F.col("_first")), tier).select(*df.columns)


def length_filter(df: DataFrame, least: int | None = None, most: int | None = None, tier: str = "length_filter", report: Report | None = None, max_share: float = MAX_DROP_SHARE) -> DataFrame:
    n = F.length("query")
    hit = (n < least if least is not None else F.lit(False)) | (n > most if most is not None else F.lit(False))
    return bounded(df, hit, tier, "length_filter", report, max_share)


def strip_prefix(df: DataFrame, pattern: str) -> DataFrame:
    """The first match at the start of the text is removed and the rest trimmed, unless nothing is left."""
    rest = strip(F.regexp_replace("query", f"^(?:{pattern})", ""))
    done = F.col("query").rlike(f"^(?:{pattern})") & (F.length(rest) > 0)
    return df.withColumn("_r", F.when(done, rest)).withColumn("wrapper_stripped", F.col("wrapper_stripped") | F.col("_r").isNotNull()).withColumn("query", F.coalesce("_r", "query")).drop("_r")


def flag_regex(df: DataFrame, pattern: str, name: str) -> DataFrame:
    return df.withColumn(f"flag_{name}", F.coalesce(F.col("query").rlike(pattern), F.lit(False)))


def bounded(df: DataFrame, hit: Column, tier: str, operation: str, report: Report | None = None, max_share: float = MAX_DROP_SHARE) -> DataFrame:
    """Tier the rows hit, or refuse: above ``max_share`` of all rows the hit becomes ``flag_refused_<tier>``."""
    hit = F.coalesce(hit, F.lit(False))
    n, k = df.agg(F.count("*"), F.sum(hit.cast("long"))).head()
    share = (k or 0) / n if n else 0.0
    if share > max_share:
        if report:
            report.refusals.append((operation, tier, share))
        return df.withColumn(f"flag_refused_{tier}", hit)
    if report:
        report.hits.append((operation, tier, k or 0))
    return _tiered(df, hit, tier)


def drop_regex(df: DataFrame, pattern: str, tier: str, report: Report | None = None, max_share: float = MAX_DROP_SHARE) -> DataFrame:
    return bounded(df, F.col("query").rlike(pattern), tier, "drop_regex", report, max_share)


def head_cut(df: DataFrame, n: int, tier: str = "head_cut") -> DataFrame:
    """Keep the ``n`` rows of most weight and all that tie with the last of them; rows without weight are cut.

    No-op for n <= 0 or n >= rows; refused where less than ``HEAD_COVERAGE`` of the rows have a weight.
    The bound is found from counts of distinct weights, not from a global sort of rows.
    """
    rows, with_weight = df.agg(F.count("*"), F.count("pv_raw")).head()
    if n <= 0 or n >= rows:
        return df
    if with_weight < HEAD_COVERAGE * rows:
        raise Refused(f"head_cut: only {with_weight} of {rows} rows have a weight")
    counts = df.where("pv_raw is not null").groupBy("pv_raw").count()
    below = running_before(counts, ["pv_raw"], "count", "_below")
    bound = below.where(with_weight - F.col("_below") - F.col("count") < n).agg(F.min("pv_raw")).head()[0]
    return _tiered(df, F.col("pv_raw").isNull() | (F.col("pv_raw") < F.lit(bound)), tier)


def aggregate_by_query(df: DataFrame) -> DataFrame:
    """One row a text, in order of first appearance: weights summed, other columns their first value that is not null."""
    others = [c for c in df.columns if c not in ("query", "pv_raw", "row_ord", "n_rows_raw")]
    size = F.sum("n_rows_raw") if "n_rows_raw" in df.columns else F.count("*")
    return df.groupBy("query").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_ord"))).alias(c) for c in others], F.sum("pv_raw").alias("pv_raw"), F.min("row_ord").alias("row_ord"), size.alias("n_rows_raw"))


def merge_collisions(df: DataFrame) -> DataFrame:
    """Texts that became equal: the first row stays with the sum of the weights and the number of rows."""
    return aggregate_by_query(df)


def normalise(df: DataFrame, snap: str = "snapshot") -> DataFrame:
    """``pv_norm``: per snapshot to a total of 10,000, over kept rows; missing weights get the least one seen, or all the same if there is none."""
    kept = df.where("tier = 'user'").withColumn("_w", positive(F.col("pv_raw")))
    stats = kept.groupBy(snap).agg(F.min("_w").alias("_least"), F.sum("_w").alias("_sum"), F.sum(F.col("_w").isNull().cast("long")).alias("_missing"))
    least = F.coalesce("_least", F.lit(1.0))
    total = F.coalesce("_sum", F.lit(0.0)) + F.col("_missing") * least
    return kept.join(stats, snap).withColumn("pv_norm", F.coalesce("_w", least) / total * WEIGHT_TOTAL).drop("_w", "_least", "_sum", "_missing")


def superset_check(previous: DataFrame, mine: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Cells of delivered rows that a rebuilt corpus does not reproduce: keys, and what is wrong."""
    a, b = previous.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values]), mine.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(True).alias("_there"))
    types = dict(previous.dtypes)
    same = [F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}")) | (F.coalesce(F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}")) <= tolerance, F.lit(False)) if types[v] == "double" else F.lit(False)) for v in values]
    wrong = F.when(F.col("_there").isNull(), "missing").otherwise(F.coalesce(*[F.when(~s, F.lit(v)) for s, v in zip(same, values)]))
    return a.join(b, keys, "left").withColumn("wrong", wrong).where("wrong is not null").select(*keys, "wrong")


def assert_superset(previous: DataFrame, mine: DataFrame, keys: list[str], values: list[str]) -> None:
    first = superset_check(previous, mine, keys, values).head()
    if first:
        raise Refused(f"a delivered row is not reproduced: {first}")


def tiers(df: DataFrame, rules: list[tuple[str, Column]], default: str = "user") -> DataFrame:
    """Priority tiers: the first rule that holds names the tier."""
    c = reduce(lambda acc, r: F.when(F.coalesce(r[1], F.lit(False)), r[0]).otherwise(acc), reversed(rules), F.lit(default))
    return df.withColumn("tier", c)


def restore_dropped(source: DataFrame, labelled: DataFrame, keys: list[str], label: str, tier: str = "tier") -> DataFrame:
    """Every source row with its label, or the reason why it has none."""
    j = source.join(labelled.select(*keys, label), keys, "left")
    return j.withColumn("reason", F.when(F.col(label).isNotNull(), "labelled").when(F.col(tier) != "user", F.col(tier)).otherwise("not labelled"))


# ---------------------------------------------------------------------------- plans


def run_plan(df: DataFrame, plan: list[dict], max_share: float = MAX_DROP_SHARE) -> tuple[DataFrame, Report]:
    """Run an ordered list of operations, each ``{"op": name, ...arguments}``."""
    report = Report()
    problems = validate_plan(plan)
    if problems:
        raise Refused("; ".join(problems))
    for step in plan:
        args = {k: v for k, v in step.items() if k not in ("op", "reason")}
        op = globals()[step["op"]]
        if step["op"] in BOUNDED:
            args |= {"report": report, "max_share": max_share}
        df = op(df, **args)
    return df, report


def validate_plan(plan: list[dict]) -> list[str]:
    """What is wrong with a plan: unknown operations, patterns that do not compile, removals without a reason, a head without n, the order."""
    out = []
    seen: list[str] = []
    for i, step in enumerate(plan):
        op = step.get("op")
        if op not in OPERATIONS:
            out.append(f"step {i}: unknown operation {op!r}")
            continue
        if op in ("strip_prefix", "flag_regex", "drop_regex"):
            try:
                re.compile(step.get("pattern") or "(")
            except re.error as e:
                out.append(f"step {i}: pattern: {e}")
        if op in ("drop_regex", "length_filter", "head_cut") and not step.get("reason"):
            out.append(f"step {i}: a removal needs a reason")
        if op == "head_cut" and not isinstance(step.get("n"), int):
            out.append(f"step {i}: head_cut needs n")
        if op == "merge_collisions" and "strip_prefix" not in seen and "trim" not in seen:
            out.append(f"step {i}: nothing before merge_collisions can make texts equal")
        seen.append(op)
    return out


def heuristic_plan(profile: dict) -> list[dict]:
    """A plan from a profile: trim always, aggregate above 5 % duplicates, strip a prefix that covers 20 %, tier empty texts."""
    plan: list[dict] = [{"op": "trim"}]
    if (p := profile.get("prefix")) and profile.get("prefix_share", 0) >= 0.2:
        plan += [{"op": "strip_prefix", "pattern": re.escape(p)}, {"op": "merge_collisions"}]
    elif profile.get("duplicate_rate", 0) > 0.05:
        plan.append({"op": "aggregate_by_query"})
    return [*plan, {"op": "drop_empty"}]


def diff_plans(base: list[dict], other: list[dict]) -> list[tuple[str, str]]:
    """Structural difference: ('removed' or 'added', step)."""
    a, b = [repr(sorted(s.items())) for s in base], [repr(sorted(s.items())) for s in other]
    return [("removed", s) for s in a if s not in b] + [("added", s) for s in b if s not in a]


def axis_of(tags: list[str]) -> str:
    """'time' if every tag is a date of its own, else 'stratum'."""
    dated = all(re.fullmatch(r"(?:19|20)\d{2}[-_]?(?:0[1-9]|1[0-2])(?:[-_]?(?:0[1-9]|[12]\d|3[01]))?", t) for t in tags)
    return "time" if dated and len(set(tags)) == len(tags) and len(tags) > 1 else "stratum"


# ---------------------------------------------------------------------------- profiles


def profile_column(df: DataFrame, column: str, order: str) -> DataFrame:
    """One column: rows, missing, distinct, constant, mean length, share of numbers, whether it never rises in file order.

    'Never rises' compares neighbours of a range-partitioned order, so no single task sees all rows.
    """
    c = F.col(column).cast("string")
    num = c.try_cast("double")
    base = df.agg(F.count("*").alias("rows"), F.sum(F.col(column).isNull().cast("long")).alias("missing"), F.count_distinct(column).alias("distinct_values"), F.avg(F.length(c)).alias("mean_length"), F.avg(F.when(c.isNotNull(), num.isNotNull().cast("int"))).alias("numeric_share"))
    return base.withColumn("constant", F.col("distinct_values") <= 1).select(F.lit(column).alias("column"), "rows", "missing", "distinct_values", "constant", "mean_length", "numeric_share")


def profile_input(df: DataFrame, text: str) -> DataFrame:
    """One row: rows, duplicate rate, median and p90 of the length, shares of Han and Latin letters, rows without content."""
    c = F.col(text)
    n = F.length(c)
    return df.agg(
        F.count("*").alias("rows"),
        (1 - F.count_distinct(c) / F.count(c)).alias("duplicate_rate"),
        F.percentile(n, F.lit(0.5)).alias("length_median"),
        F.percentile(n, F.lit(0.9)).alias("length_p90"),
        (F.sum(F.regexp_count(c, F.lit(r"[\x{4E00}-\x{9FFF}]"))) / F.sum(n)).alias("han_share"),
        (F.sum(F.regexp_count(c, F.lit("[A-Za-z]"))) / F.sum(n)).alias("latin_share"),
        F.avg((~has_content(c)).cast("int")).alias("no_content_share"),
    )


def repeated_short(df: DataFrame, text: str, longest: int = 12, least: int = 3, most: int = 20) -> DataFrame:
    """The most repeated short texts; ties by text."""
    return df.where(F.length(text) <= longest).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "text").limit(most)


def prefix_counts(df: DataFrame, text: str, shortest: int = 3, longest: int = 16, min_share: float = 0.02) -> DataFrame:
    """Prefixes at the start of at least ``min_share`` of the rows, with counts and the shortest text that has them."""
    n = F.length(text)
    rows = df.where(n >= shortest).select(F.explode(F.sequence(F.lit(shortest), F.least(n, F.lit(longest)))).alias("k"), F.col(text).alias("t"))
    total = df.count()
    return rows.groupBy(F.substring("t", F.lit(1), F.col("k")).alias("prefix")).agg(F.count("*").alias("n"), F.min(F.length("t")).alias("shortest")).where(F.col("n") >= min_share * total).withColumn("share", F.col("n") / total)


def wrapper_prefixes(counts: list[tuple[str, int, int]], keep: float = 0.9) -> list[tuple[str, int]]:
    """Grow each shortest prefix while its most frequent extension keeps ``keep`` of its rows and 2 characters remain; nested ones are dropped."""
    n = {p: c for p, c, _ in counts}
    room = {p: s for p, _, s in counts}
    if not n:
        return []
    base = min(map(len, n))
    out: list[tuple[str, int]] = []
    for p in sorted((p for p in n if len(p) == base), key=lambda p: (-n[p], p)):
        while True:
            longer = [q for q in n if len(q) == len(p) + 1 and q.startswith(p)]
            best = max(longer, key=lambda q: (n[q], q), default=None)
            if best is None or n[best] < keep * n[p] or len(best) > room[best] - 2:
                break
            p = best
        if not any(p.startswith(q) or q.startswith(p) for q, _ in out):
            out.append((p, n[p]))
    return out
