"""Labels: agreement, adjudication, rules, calibration, gold assembly, promotion."""

from __future__ import annotations

import math
from collections import Counter
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S

UNLABELED = "UNLABELED"


# ---------------------------------------------------------------------------- agreement


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows both labelled, raw agreement and Cohen's kappa (0 where it is not defined); from the table of label pairs."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != UNLABELED) & (F.col(b) != UNLABELED)).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    t = t.withColumn("ra", F.sum("n").over(Window.partitionBy("a"))).withColumn("rb", F.sum("n").over(Window.partitionBy("b")))
    both = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    # the chance agreement needs the product of the margins once a class: rows of equal labels, and classes without any
    s = t.agg(F.sum("n").alias("n"), F.sum(both).alias("k"))
    ma, mb = t.select("a", "ra").distinct(), t.select(F.col("b").alias("a"), "rb").distinct()
    e = ma.join(mb, "a").agg(F.sum(F.col("ra").cast("double") * F.col("rb")).alias("e"))
    r = s.join(e, F.lit(True))
    po, pe = F.col("k") / F.col("n"), F.coalesce("e", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return r.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(0.0).alias("kappa"))


def fleiss(df: DataFrame, item: str, category: str) -> DataFrame:
    """Fleiss' kappa over items with the most frequent number of ratings; null where chance agreement is 1."""
    c = df.where(F.col(item).isNotNull() & F.col(category).isNotNull()).groupBy(F.col(item).alias("item"), F.col(category).alias("cat")).agg(F.count("*").alias("n"))
    items = c.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).where("m > 1")
    mode = items.groupBy("m").count().select(F.struct("count", "m").alias("s")).agg(F.max("s").alias("s")).select(F.col("s.m").alias("m"))
    chosen = items.join(F.broadcast(mode), "m")
    p = chosen.agg(F.count("*").alias("items"), F.max("m").alias("m"), F.avg(F.col("pairs") / (F.col("m") * (F.col("m") - 1))).alias("po"))
    cats = c.join(chosen.select("item", "m"), "item").groupBy("cat").agg(F.sum("n").alias("n"), F.max("m").alias("m"))
    pe = cats.agg((F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))).alias("pe"))
    return p.join(pe, F.lit(True)).select("items", F.col("m").alias("ratings"), "po", "pe", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def annotator_balance(df: DataFrame, a: str, b: str, final: str) -> DataFrame:
    """Whom the referee sided with where two readers differed; z against even, undecidable below 20, lopsided above 3."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(final).isNotNull() & (F.col(a) != F.col(b)))
    s = d.agg(F.sum((F.col(final) == F.col(a)).cast("long")).alias("a_wins"), F.sum((F.col(final) == F.col(b)).cast("long")).alias("b_wins"), F.sum(((F.col(final) != F.col(a)) & (F.col(final) != F.col(b))).cast("long")).alias("neither"))
    n = F.col("a_wins") + F.col("b_wins")
    z = F.when(n > 0, (F.col("a_wins") - F.col("b_wins")) / F.sqrt(n)).otherwise(0.0)
    return s.select("a_wins", "b_wins", "neither", z.alias("z"), F.when(n < 20, "undecidable").when(F.abs(z) > 3, "lopsided").otherwise("balanced").alias("verdict"))


def contested(df: DataFrame, a: str, b: str, final: str) -> DataFrame:
    """Unordered pairs of labels that were settled to more than one final label."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(final).isNotNull() & (F.col(a) != F.col(b)))
    return d.groupBy(F.least(a, b).alias("class_a"), F.greatest(a, b).alias("class_b")).agg(F.count("*").alias("n"), F.count_distinct(final).alias("finals")).where("finals > 1")


def score_verdicts(wins: int, losses: int, ties: int, alpha: float = 0.05, least: int = 10) -> dict[str, float | bool | int]:
    """Sign test of a challenger: ties are out, ``least`` decided, more than half won, normal p below ``alpha``."""
    n = wins + losses
    share = wins / n if n else 0.0
    p = math.erfc(abs(wins - n / 2) / math.sqrt(n / 4) / math.sqrt(2)) if n else 1.0
    return {"decided": n, "ties": ties, "share": share, "p": p, "promoted": n >= least and share > 0.5 and p < alpha}


def proportion_gate(k: Column, n: Column, threshold: float, z: float = 1.96) -> Column:
    """'met', 'missed' or 'underpowered' by the interval of k of n against a threshold."""
    lo, hi = S.wilson(k, n, z, (0.0, 1.0))
    return F.when(lo >= threshold, "met").when(hi < threshold, "missed").otherwise("underpowered")


def required_n(observed: Column, threshold: float, z: float = 1.96) -> Column:
    """Rows needed to tell a share from a threshold; null where they are the same."""
    gap = F.abs(observed - threshold)
    return F.when(gap > 1e-9, F.ceil(z * z * observed * (1 - observed) / (gap * gap)))


def score_partition(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, normalised and adjusted mutual information and purity of two labelings, from their contingency table.

    The table is aggregated in the cluster; only it (classes x clusters cells) reaches the driver.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n")).limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("the contingency table has more than a million cells")
    s = partition_scores([(r.a, r.b, r.n) for r in rows])
    return df.sparkSession.createDataFrame([tuple(s[k] for k in ("n", "ari", "nmi", "ami", "purity"))], "n bigint, ari double, nmi double, ami double, purity double")


def partition_scores(cells: list[tuple[str, str, int]]) -> dict[str, float]:
    n = sum(c for _, _, c in cells)
    ra: dict[str, int] = {}
    rb: dict[str, int] = {}
    for a, b, c in cells:
        ra[a] = ra.get(a, 0) + c
        rb[b] = rb.get(b, 0) + c
    two = lambda x: x * (x - 1) / 2
    index, sa, sb = sum(two(c) for _, _, c in cells), sum(map(two, ra.values())), sum(map(two, rb.values()))
    expected = sa * sb / two(n) if n > 1 else 0.0
    best = (sa + sb) / 2
    ari = (index - expected) / (best - expected) if best != expected else 1.0
    h = lambda r: -sum(c / n * math.log(c / n) for c in r.values() if c)
    mi = sum(c / n * math.log(c * n / (ra[a] * rb[b])) for a, b, c in cells if c) if n else 0.0
    ha, hb = (h(ra), h(rb)) if n else (0.0, 0.0)
    mean = (ha + hb) / 2
    emi = _expected_mi(list(ra.values()), list(rb.values()), n) if n else 0.0
    by_b: dict[str, int] = {}
    for _, b, c in cells:
        by_b[b] = max(by_b.get(b, 0), c)
    return {"n": n, "ari": ari, "nmi": mi / mean if mean else 1.0, "ami": (mi - emi) / (mean - emi) if abs(mean - emi) > 1e-12 else 1.0, "purity": sum(by_b.values()) / n if n else 0.0}


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """log x! by Stirling's series, from eight above x."""
    y = x + 9.0
    shift = sum(np.log(x + k) for k in range(1, 9))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _expected_mi(ra: list[int], rb: list[int], n: int) -> float:
    """Expected mutual information of random tables with these margins (hypergeometric); equal margins are computed once.

    Counts farther than 12 deviations (and 40) from their mean are left out: their probability is below 10^-30.
    """
    total = 0.0
    for a, ka in Counter(ra).items():
        for b, kb in Counter(rb).items():
            mean = a * b / n
            reach = 40 + 12 * math.sqrt(mean * (1 - a / n) * (1 - b / n))
            x = np.arange(max(1, a + b - n, math.floor(mean - reach)), min(a, b, math.ceil(mean + reach)) + 1, dtype=float)
            top = _log_factorial(np.array([a, b, n - a, n - b], float)).sum() - _log_factorial(np.array([float(n)]))[0]
            p = np.exp(top - _log_factorial(x) - _log_factorial(a - x) - _log_factorial(b - x) - _log_factorial(n - a - b + x))
            total += ka * kb * float((p * x / n * np.log(n * x / (a * b))).sum())
    return total


# ---------------------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    label: str


def validate_rules(gold: DataFrame, text: str, label: str, rules: list[Rule], precision: float = 0.98) -> DataFrame:
    """Hits and precision of each rule on gold rows; accepted at ``precision``, never without a hit. One pass for all rules."""
    aggs = []
    for i, r in enumerate(rules):
        hit = F.coalesce(F.col(text).rlike(r.pattern), F.lit(False))
        aggs += [F.sum(hit.cast("long")).alias(f"h{i}"), F.sum((hit & (F.col(label) == r.label)).cast("long")).alias(f"k{i}")]
    s = gold.where(F.col(label).isNotNull()).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(r.label).alias("label"), F.coalesce(F.col(f"h{i}"), F.lit(0)).alias("hits"), F.coalesce(F.col(f"k{i}"), F.lit(0)).alias("right")) for i, r in enumerate(rules)])
    t = s.select(F.explode(rows).alias("x")).select("x.*")
    p = S.ratio(F.col("right").cast("double"), F.col("hits"))
    return t.withColumn("precision", p).withColumn("accepted", F.coalesce(p >= precision, F.lit(False)))


def apply_rules(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """``rule`` and ``rule_label`` of the first rule, in order, that holds."""
    hits = [F.when(F.coalesce(F.col(text).rlike(r.pattern), F.lit(False)), F.struct(F.lit(r.id).alias("rule"), F.lit(r.label).alias("label"))) for r in rules]
    return df.withColumn("_r", F.coalesce(*hits)).withColumn("rule", F.col("_r.rule")).withColumn("rule_label", F.col("_r.label")).drop("_r")


def rule_matrix(df: DataFrame, text: str, rules: list[Rule], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.coalesce(F.col(text).rlike(r.pattern), F.lit(False)).alias(f"rule_{r.id}") for r in rules])


def validate_trigger(df: DataFrame, text: str, trigger: str, evidence: list[str], max_share: float = 0.5) -> list[str]:
    """What is wrong with a trigger: it must compile, fire on its own evidence, on some row and on at most half of the rows."""
    try:
        compiled = re.compile(trigger)
    except re.error as e:
        return [f"does not compile: {e}"]
    out = [f"does not fire on its evidence {x!r}" for x in evidence if not compiled.search(x)]
    n, k = df.agg(F.count("*"), F.sum(F.coalesce(F.col(text).rlike(trigger), F.lit(False)).cast("long"))).head()
    if not k:
        out.append("fires on no row")
    elif k > max_share * n:
        out.append(f"fires on {k} of {n} rows")
    return out


def rule_conflicts(df: DataFrame, text: str, rules: list[Rule], least: int = 25) -> DataFrame:
    """Pairs of rules with different labels that fire together on ``least`` rows, with Jaccard.

    Rows become the set of rules that fire; equal sets are counted once, so pairs are formed per set, not per row.
    """
    fired = F.array_compact(F.array(*[F.when(F.coalesce(F.col(text).rlike(r.pattern), F.lit(False)), F.lit(i)) for i, r in enumerate(rules)]))
    sets = df.select(fired.alias("f")).where(F.size("f") > 0).groupBy("f").agg(F.count("*").alias("n"))
    single = sets.select(F.explode("f").alias("i"), "n").groupBy("i").agg(F.sum("n").alias("n"))
    pairs = sets.select(F.explode("f").alias("i"), "f", "n").select("i", F.explode("f").alias("j"), "n").where("i < j").groupBy("i", "j").agg(F.sum("n").alias("n_both")).where(F.col("n_both") >= least)
    ids = F.array(*[F.lit(r.id) for r in rules])
    labels = F.array(*[F.lit(r.label) for r in rules])
    a, b = single.select("i", F.col("n").alias("n_a")), single.select(F.col("i").alias("j"), F.col("n").alias("n_b"))
    t = pairs.join(a, "i").join(b, "j").where(F.get(labels, F.col("i")) != F.get(labels, F.col("j")))
    return t.select(F.get(ids, F.col("i")).alias("rule_a"), F.get(ids, F.col("j")).alias("rule_b"), "n_both", (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard"))


def rules_against_evidence(gold: DataFrame, a: str, b: str, final: str, least: int = 8) -> DataFrame:
    """Per boundary of two classes: verdicts, the majority with interval, and whether it is decisive."""
    d = gold.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)) & ((F.col(final) == F.col(a)) | (F.col(final) == F.col(b))))
    c = d.groupBy(F.least(a, b).alias("class_a"), F.greatest(a, b).alias("class_b"), F.col(final).alias("verdict")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("class_a", "class_b")
    c = c.withColumn("t", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), F.col("verdict").asc()))).where((F.col("r") == 1) & (F.col("t") >= least))
    lo, hi = S.wilson(F.col("n"), F.col("t"))
    return c.select("class_a", "class_b", F.col("t").alias("n"), F.col("verdict").alias("majority"), (F.col("n") / F.col("t")).alias("share"), lo.alias("lo"), hi.alias("hi"), (lo > 0.5).alias("decisive"))


def stated_grounds(gold: DataFrame, text: str, a: str, b: str, final: str, marker: str) -> DataFrame:
    """Does a quoted discriminator split the adjudicated rows? Rows and verdicts with and without it, by boundary."""
    d = gold.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)) & F.col(final).isNotNull())
    return d.groupBy(F.least(a, b).alias("class_a"), F.greatest(a, b).alias("class_b"), F.coalesce(F.col(text).contains(marker), F.lit(False)).alias("with_marker")).agg(F.count("*").alias("n"), F.count_distinct(final).alias("verdicts"))


def normalise_code(text: str, codes: list[str]) -> str | None:
    """A free text as one of the codes: equal, equal without case, or the single longest one it names as a whole word."""
    if text in codes:
        return text
    low = {c.casefold(): c for c in codes}
    if text.strip().casefold() in low:
        return low[text.strip().casefold()]
    named = [c for c in codes if re.search(rf"(?<!\w){re.escape(c.casefold())}(?!\w)", text.casefold())]
    longest = [c for c in named if not any(c != o and c.casefold() in o.casefold() for o in named)]
    return longest[0] if len(longest) == 1 else None


def usable_markers(quoted: list[str]) -> list[str]:
    """Split enumerations; no placeholders, nothing above 8 characters, with digits or spaces."""
    parts = [p.strip() for q in quoted for p in re.split(r"[、,，/|]", q)]
    return list(dict.fromkeys(p for p in parts if p and len(p) <= 8 and not re.search(r"[\d\s{}<>…X*]", p)))


# ---------------------------------------------------------------------------- calibration, gold, promotion


def ece(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Bins (lo, hi] of the confidence: rows, mean confidence, accuracy and their part of the calibration error."""
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.col(confidence) * bins).cast("int")))
    t = df.where(F.col(confidence).isNotNull() & ~F.isnan(confidence)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("int")).alias("accuracy"))
    return t.withColumn("part", F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a bin


def ece_noise_floor(df: DataFrame, confidence: str, simulations: int = 50, bins: int = 10, seed: int = 0) -> DataFrame:
    """Calibration error of a perfectly calibrated model on these confidences: mean and 95 % point over simulations.

    Each row draws its outcome from a hash of its confidence, a row hash and the simulation; all simulations share one aggregate.
    """
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.col("c") * bins).cast("int")))
    rows = df.where(F.col(confidence).isNotNull()).select(F.col(confidence).alias("c"), F.xxhash64(*[F.col(x) for x in df.columns]).alias("h"))
    sims = rows.select("c", "h", b.alias("bin"))
    hit = [((F.pmod(F.xxhash64("h", F.lit(seed + s)), F.lit(1_000_000)) / 1_000_000.0) < F.col("c")).cast("int") for s in range(simulations)]
    t = sims.groupBy("bin").agg(F.count("*").alias("n"), F.sum("c").alias("sc"), *[F.sum(h).alias(f"s{i}") for i, h in enumerate(hit)])
    total = t.agg(F.sum("n").alias("total"), *[F.sum(F.abs(F.col("sc") - F.col(f"s{i}"))).alias(f"e{i}") for i in range(simulations)])
    v = total.select(F.explode(F.array(*[F.col(f"e{i}") / F.col("total") for i in range(simulations)])).alias("e"))
    return v.agg(F.avg("e").alias("mean"), F.percentile("e", F.lit(0.95)).alias("p95"))


def assemble_gold(df: DataFrame, a: str, b: str, referee: str, codes: list[str]) -> DataFrame:
    """status (agreed, disagreement, missing) and final label; labels that are no code count as missing; the referee decides disagreements."""
    ok = lambda c: F.when(F.col(c).isin(*codes), F.col(c)).otherwise(UNLABELED)
    x, y = ok(a), ok(b)
    status = F.when((x == UNLABELED) | (y == UNLABELED), "missing").when(x == y, "agreed").otherwise("disagreement")
    final = F.when(status == "agreed", x).when(status == "disagreement", F.when(F.col(referee).isin(*codes), F.col(referee)))
    return df.withColumn("status", status).withColumn("gold", final)


def promote(df: DataFrame, old: str, new: str, promoted: bool) -> DataFrame:
    """``label_final`` with its source; the old label stays as ``<old>_v1``."""
    c = F.coalesce(F.col(new), F.col(old)) if promoted else F.col(old)
    src = F.when(F.lit(promoted) & F.col(new).isNotNull() & ~F.col(new).eqNullSafe(F.col(old)), "challenger").otherwise("incumbent")
    return df.withColumn(f"{old}_v1", F.col(old)).withColumn("label_final", c).withColumn("label_source", src)


def disagreements(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows where two labels differ."""
    return df.where(~F.col(old).eqNullSafe(F.col(new)))


def gold_size(n: int) -> int:
    """3000, or 30 % of a small corpus, at most 60 % and at least 50 of it."""
    return max(min(50, n), min(max(3000 if n >= 10_000 else round(0.3 * n), 0), round(0.6 * n)))
