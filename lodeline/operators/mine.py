"""Mining of phrasing: affixes, groups, coverage, fragmentation, distinctive grams and log-odds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.text import grams, tokens
from ..session import materialise


def affixes(df: DataFrame, text: str, shortest: int = 2, longest: int = 6, least: int = 60) -> DataFrame:
    """Suffixes and prefixes of texts without punctuation at their ends, strictly shorter than the text; score is count times length."""
    t = df.where(F.col(text).isNotNull()).select(F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("t"))
    n = F.length("t")
    e = t.where(n > shortest).select("t", F.explode(F.sequence(F.lit(shortest), F.least(n - 1, F.lit(longest)))).alias("k"))
    sides = F.array(F.struct(F.lit("prefix").alias("side"), F.substring("t", F.lit(1), F.col("k")).alias("affix")), F.struct(F.lit("suffix").alias("side"), F.substring("t", F.length("t") - F.col("k") + 1, F.col("k")).alias("affix")))
    c = e.select(F.explode(sides).alias("x")).groupBy("x.side", "x.affix").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return c.withColumn("score", F.col("n") * F.length("affix"))


def drop_subsumed(found: list[tuple[str, int]], most: int = 60, factor: float = 1.3) -> list[tuple[str, int]]:
    """In order of score: an affix inside (or around) a kept one goes, unless it is ``factor`` times as frequent."""
    out: list[tuple[str, int]] = []
    for a, n in sorted(found, key=lambda x: (-x[1] * len(x[0]), x[0])):
        if len(out) >= most:
            break
        if all(n > factor * m for b, m in out if a in b or b in a):
            out.append((a, n))
    return out


@dataclass(frozen=True)
class Group:
    """A phrasing: texts that match ``pattern``."""

    name: str
    pattern: str
    seed: bool = False


def masks(df: DataFrame, text: str, groups: list[Group], keep: list[str]) -> DataFrame:
    """Long form of the memberships: ``keep`` and grp, one row per group a text belongs to. One pass, no shuffle."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(F.col(text).rlike(g.pattern), F.lit(False)), g.name) for g in groups]))
    return df.select(*keep, F.explode(hits).alias("grp"))


def coverage(df: DataFrame, text: str, groups: list[Group], window: tuple[float, float] = (0.2, 0.4)) -> DataFrame:
    """Share of each group, and of their union (grp 'any') with a verdict against the window."""
    one = [F.coalesce(F.col(text).rlike(g.pattern), F.lit(False)) for g in groups]
    any_ = one[0]
    for c in one[1:]:
        any_ = any_ | c
    s = df.agg(F.count("*").alias("n"), F.sum(any_.cast("long")).alias("any"), *[F.sum(c.cast("long")).alias(f"g{i}") for i, c in enumerate(one)])
    rows = F.array(F.struct(F.lit("any").alias("grp"), F.col("any").alias("n")), *[F.struct(F.lit(g.name).alias("grp"), F.col(f"g{i}").alias("n")) for i, g in enumerate(groups)])
    t = s.select(F.explode(rows).alias("r"), F.col("n").alias("total")).select("r.grp", "r.n", (F.col("r.n") / F.col("total")).alias("share"))
    verdict = F.when(F.col("grp") != "any", F.lit(None)).when(F.col("share") < window[0], "too low").when(F.col("share") > window[1], "too high").otherwise("in window")
    return t.withColumn("verdict", verdict)


def build_groups(df: DataFrame, text: str, candidates: list[Group], min_share: float = 0.004, max_overlap: float = 0.85) -> list[Group]:
    """Groups in order, each with ``min_share`` of the rows and at most ``max_overlap`` of its rows already in an earlier one.

    One aggregate counts every group and, for each, how many of its rows an accepted group before it holds.
    The counts of all first-claim patterns are bounded by the number of candidates squared.
    """
    hit = [F.coalesce(F.col(text).rlike(g.pattern), F.lit(False)) for g in candidates]
    bits = df.select(F.array(*hit).alias("h")).groupBy("h").count()
    patterns = [(r.h, r["count"]) for r in bits.collect()]  # distinct combinations of a short list of patterns
    total = sum(n for _, n in patterns)
    out: list[Group] = []
    taken: list[int] = []
    for i, g in enumerate(candidates):
        n = sum(c for h, c in patterns if h[i])
        both = sum(c for h, c in patterns if h[i] and any(h[j] for j in taken))
        if total and n / total >= min_share and both <= max_overlap * n:
            out.append(g)
            taken.append(i)
    return out


def select_for_coverage(df: DataFrame, text: str, groups: list[Group], window: tuple[float, float] = (0.2, 0.4), most: int = 40) -> list[Group]:
    """Seeds first, then longer patterns, while the union stays at or below the upper end of the window."""
    hit = [F.coalesce(F.col(text).rlike(g.pattern), F.lit(False)) for g in groups]
    patterns = [(r.h, r["count"]) for r in df.select(F.array(*hit).alias("h")).groupBy("h").count().collect()]
    total = sum(n for _, n in patterns) or 1
    order = sorted(range(len(groups)), key=lambda i: (not groups[i].seed, -len(groups[i].pattern), -sum(c for h, c in patterns if h[i]), groups[i].name))
    chosen: list[int] = []
    for i in order:
        union = sum(c for h, c in patterns if h[i] or any(h[j] for j in chosen))
        if len(chosen) < most and (groups[i].seed or union / total <= window[1]):
            chosen.append(i)
    return [groups[i] for i in chosen]


def fragmentation(members: DataFrame, group: str, cluster: str, least: int = 30) -> DataFrame:
    """Per group: members and the effective number of clusters they are in; noise labels below 0 are dropped."""
    c = members.where(F.col(cluster).isNotNull() & (F.col(cluster) >= 0)).groupBy(F.col(group).alias("grp"), F.col(cluster).alias("c")).agg(F.count("*").alias("n"))
    c = c.withColumn("t", F.sum("n").over(Window.partitionBy("grp"))).where(F.col("t") >= least)
    return c.groupBy("grp").agg(F.max("t").alias("members"), F.exp(S.entropy(F.col("n") / F.col("t"))).alias("effective"), F.count("*").alias("clusters"))


def adjusted_fragmentation(fr: DataFrame, labels: DataFrame, cluster: str) -> DataFrame:
    """Fragmentation against what the sizes of the clusters alone would give: 1 is one cluster, 0 is chance."""
    c = labels.where(F.col(cluster).isNotNull() & (F.col(cluster) >= 0)).groupBy(cluster).agg(F.count("*").alias("n"))
    e = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy())).agg(F.exp(S.entropy(F.col("p"))).alias("expected"))  # one row a cluster
    return fr.join(F.broadcast(e), F.lit(True)).withColumn("adjusted", S.ratio(F.col("expected") - F.col("effective"), F.col("expected") - 1))


def template_spread(members: DataFrame, group: str, cluster: str, top: int = 5, least: int = 20) -> DataFrame:
    """Per group: its first clusters with their shares."""
    c = members.where(F.col(cluster).isNotNull()).groupBy(F.col(group).alias("grp"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp")
    c = c.withColumn("members", F.sum("n").over(w)).withColumn("touched", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), F.col("cluster").asc())))
    return c.where((F.col("members") >= least) & (F.col("r") <= top)).select("grp", "members", "touched", F.col("r").cast("bigint").alias("r"), "cluster", (F.col("n") / F.col("members")).alias("share"))


def distinctive_grams(df: DataFrame, text: str, group: str, shortest: int = 2, longest: int = 4, min_rate: float = 0.03) -> DataFrame:
    """Character grams by document frequency in each group against all: those in 3 texts and ``min_rate`` of the group; score is lift times rate."""
    rows = df.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.array_distinct(grams(F.col(text), shortest, longest)).alias("g"))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n_grp"))
    c = rows.select("grp", F.explode("g").alias("gram")).groupBy("grp", "gram").agg(F.count("*").alias("n"))
    all_ = c.groupBy("gram").agg(F.sum("n").alias("n_all"))
    total = sizes.agg(F.sum("n_grp").alias("total"))
    j = c.join(F.broadcast(sizes), "grp").where(F.col("n") >= F.greatest(F.lit(3.0), min_rate * F.col("n_grp"))).join(all_, "gram").join(F.broadcast(total), F.lit(True))
    rate = F.col("n") / F.col("n_grp")
    return j.select("grp", "gram", "n", rate.alias("rate"), (rate / (F.col("n_all") / F.col("total"))).alias("lift"), (rate * rate / (F.col("n_all") / F.col("total"))).alias("score"))


def drop_substrings(scored: list[tuple[str, float]], top: int = 12) -> list[str]:
    """The best grams, without those inside a better one (or around it)."""
    out: list[str] = []
    for g, _ in sorted(scored, key=lambda x: (-x[1], x[0])):
        if len(out) == top:
            break
        if not any(g in o or o in g for o in out):
            out.append(g)
    return out


def log_odds(df: DataFrame, text: str, side: str, a: str, b: str, weight: str | None = None, prior: float = 500.0, by_document: bool = False, how: str = "words") -> DataFrame:
    """Log-odds of words in a against b with an informative prior of the corpus; z is its score.

    ``by_document`` counts a word once a text. Counts are combined before their shuffle.
    """
    t = tokens(F.col(text), how)
    t = F.array_distinct(t) if by_document else t
    w = F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)
    rows = df.where(F.col(text).isNotNull() & F.col(side).isin(a, b)).select(F.col(side).alias("s"), w.alias("w"), F.explode(t).alias("word"))
    c = rows.groupBy("word").agg(F.sum(F.when(F.col("s") == a, F.col("w")).otherwise(0.0)).alias("ya"), F.sum(F.when(F.col("s") == b, F.col("w")).otherwise(0.0)).alias("yb"))
    n = c.agg(F.sum("ya").alias("na"), F.sum("yb").alias("nb"))
    c = c.join(F.broadcast(n), F.lit(True))
    alpha = prior * (F.col("ya") + F.col("yb")) / (F.col("na") + F.col("nb"))
    odds = lambda y, total: F.ln((F.col(y) + alpha) / (F.col(total) + prior - F.col(y) - alpha))
    delta = odds("ya", "na") - odds("yb", "nb")
    return c.select("word", "ya", "yb", delta.alias("delta"), (delta / F.sqrt(1 / (F.col("ya") + alpha) + 1 / (F.col("yb") + alpha))).alias("z"))


def discriminating_markers(rows: list[tuple[str, str]], pair: tuple[str, str], support: int = 4, precision: float = 0.9, most: int = 4) -> list[tuple[str, str, int]]:
    """Grams of 2 to 4 characters that tell a pair of classes apart: greedy cover of the agreed texts of the pair.

    ``rows`` are (text, class) of the agreed rows of one pair, a labelled sample of hundreds.
    """
    mine = [(t, c) for t, c in rows if c in pair]
    found: dict[str, set[int]] = {}
    for i, (t, _) in enumerate(mine):
        for k in (2, 3, 4):
            for j in range(len(t) - k + 1):
                found.setdefault(t[j : j + k], set()).add(i)
    good: dict[str, tuple[str, set[int]]] = {}
    for g, at in found.items():
        for c in pair:
            right = {i for i in at if mine[i][1] == c}
            if len(right) >= support and len(right) >= precision * len(at):
                good[g] = (c, right)
    out: list[tuple[str, str, int]] = []
    covered: set[int] = set()
    while good and len(out) < most:
        g = min(good, key=lambda x: (-len(good[x][1] - covered), len(x), x))
        gain = len(good[g][1] - covered)
        if gain < 1:
            break
        out.append((g, good[g][0], gain))
        covered |= good.pop(g)[1]
    return out


def boundary_default(rows: list[tuple[str, str]], pair: tuple[str, str], markers: list[str], support: int = 20, precision: float = 0.75) -> str | None:
    """The class of most agreed texts of a pair that hold no marker, if it is clear."""
    left = [c for t, c in rows if c in pair and not any(m in t for m in markers)]
    for c in pair:
        k = left.count(c)
        if len(left) >= support and k >= precision * len(left):
            return c
    return None


def pair_markers(rows: DataFrame, text: str, cls: str, pairs: list[tuple[str, str]], support: int = 4, precision: float = 0.9, most: int = 4, default_support: int = 20, default_precision: float = 0.75) -> list[tuple[str, str, str, str, int, str | None]]:
    """(class_a, class_b, marker, points_to, gain, default) of many pairs over texts of any number.

    What :func:`discriminating_markers` and :func:`boundary_default` say of each pair, counted in the cluster: the driver
    gets at most ``most`` markers and two counts a pair. Pairs are at most the number of classes squared.
    """
    if not pairs:
        return []
    spark = rows.sparkSession
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("id"), F.col(text).alias("t"), F.col(cls).alias("c")).where("t is not null and c is not null"))
    sides = F.broadcast(spark.createDataFrame([(p, a, b) for p, (x, y) in enumerate(pairs) for a, b in ((x, y), (y, x))], "p int, c string, other string"))
    each = materialise(rows.join(sides.select("c").distinct(), "c", "left_semi").select("id", "c", F.explode(F.array_distinct(grams(F.col("t"), 2, 4))).alias("g")))
    counts = materialise(each.groupBy("g", "c").agg(F.count("*").alias("n")))
    strong = counts.where(F.col("n") >= support).join(sides, "c")
    wrong = counts.select("g", F.col("c").alias("other"), F.col("n").alias("m"))
    good = strong.join(wrong, ["g", "other"], "left").where(F.col("n") >= F.lit(precision) * (F.col("n") + F.coalesce("m", F.lit(0)))).select("p", "g", "c")
    left = materialise(each.join(good, ["g", "c"]).select("p", "g", "c", "id"))
    chosen: list[tuple[int, str, str, int]] = []
    for _ in range(most):
        gain = left.groupBy("p", "g", "c").agg(F.count("*").alias("n"))
        best = [(r.p, r.b.g, r.b.c, -r.b.n) for r in gain.groupBy("p").agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("g").alias("k"), "g", "c")).alias("b")).collect()]  # one row a pair
        if not best:
            break
        chosen += best
        taken = F.broadcast(spark.createDataFrame([b[:2] for b in best], "p int, g string"))
        left = materialise(left.join(left.join(taken, ["p", "g"], "left_semi").select("p", "id"), ["p", "id"], "left_anti"))
    marks = spark.createDataFrame([(p, [g for q, g, _, _ in chosen if q == p]) for p in range(len(pairs))], "p int, marks array<string>")
    bare = rows.join(sides, "c").join(F.broadcast(marks), "p").where(~F.exists("marks", lambda m: F.col("t").contains(m)))
    n = {(r.p, r.c): r["count"] for r in bare.groupBy("p", "c").count().collect()}  # two rows a pair
    default = {}
    for p, pair in enumerate(pairs):
        total = sum(n.get((p, c), 0) for c in pair)
        default[p] = next((c for c in pair if total >= default_support and n.get((p, c), 0) >= default_precision * total), None)
    return [(*pairs[p], g, c, k, default[p]) for p, g, c, k in sorted(chosen, key=lambda x: x[0])]
