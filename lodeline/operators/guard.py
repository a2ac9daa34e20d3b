"""Which rows may be quoted, what was printed, and whether a report's numbers and quotations hold.

A guard is seven layers, each a column, so a row is blocked for a reason that can be counted.
Lists of ids or texts come as tables and are joined, patterns stay separate. A null text hits
no pattern and is not quotable.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("risk", "hard", "together", "named", "class", "declared", "screened")


@dataclass(frozen=True)
class Guard:
    """``hard``: patterns by name; ``together``: pairs that block only side by side; ``declared``: a run's own patterns; ``classes``: never quoted."""

    hard: dict[str, str]
    together: tuple[tuple[str, str], ...] = ()
    declared: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()


def compiled(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """The patterns, each compiled on its own by Python and by the JVM; a bad one is named."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(p)
        except Exception as e:
            raise ValueError(f"pattern {p!r} does not compile: {str(e).splitlines()[0]}") from None
        out.append(p)
    return out


def _hit(text: str, pattern: str) -> Column:
    return F.coalesce(F.col(text).rlike(pattern), F.lit(False))


def _any(hits: list[Column]) -> Column:
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def layers(df: DataFrame, unique: str, text: str, cls: str, guard: Guard, risk: DataFrame | None = None, named: DataFrame | None = None, screened: DataFrame | None = None) -> DataFrame:
    """``df`` with a boolean column a layer and ``quotable``.

    ``risk`` has ids in a column ``unique``; ``named`` and ``screened`` have texts in a column ``text``.
    """
    compiled(df.sparkSession, [*guard.hard.values(), *(p for pair in guard.together for p in pair), *guard.declared])
    out = df
    for name, listed, key in (("risk", risk, unique), ("named", named, text), ("screened", screened, text)):
        if listed is None:
            out = out.withColumn(name, F.lit(False))
        else:
            marks = listed.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
            out = out.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    out = out.withColumn("hard", _any([_hit(text, p) for p in guard.hard.values()]))
    out = out.withColumn("together", _any([_hit(text, a) & _hit(text, b) for a, b in guard.together]))
    out = out.withColumn("class", F.coalesce(F.col(cls).isin(*guard.classes), F.lit(False)) if guard.classes else F.lit(False))
    out = out.withColumn("declared", _any([_hit(text, p) for p in guard.declared]))
    blocked = _any([F.col(x) for x in LAYERS])
    return out.select(*df.columns, *LAYERS, (~blocked & F.col(text).isNotNull()).alias("quotable"))


def counts(layered: DataFrame) -> DataFrame:
    """Rows blocked by each layer, by any, quotable ones and all, as (layer, n)."""
    n = lambda c: F.sum(c.cast("long"))
    one = layered.agg(*[n(F.col(x)).alias(x) for x in LAYERS], n(_any([F.col(x) for x in LAYERS])).alias("any"), n(F.col("quotable")).alias("quotable"), F.count("*").alias("all"))
    names = [*LAYERS, "any", "quotable", "all"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.coalesce(F.col(x), F.lit(0)).alias("n")) for x in names])).alias("r")).select("r.layer", "r.n")


def hard_rule_scan(df: DataFrame, text: str, snap: str, guard: Guard, printed: DataFrame) -> DataFrame:
    """(rule, text, snap, printed), once each: every text a hard rule hits, whatever the layers said, and whether it was printed."""
    rules = F.array_compact(F.array(*[F.when(_hit(text, p), F.lit(k)) for k, p in guard.hard.items()]))
    hits = df.select(F.explode(rules).alias("rule"), text, snap).distinct()
    shown = printed.select(F.col(text)).distinct().withColumn("printed", F.lit(True))
    return hits.join(shown, text, "left").select("rule", text, snap, F.coalesce("printed", F.lit(False)).alias("printed"))


def patterns_to_guard(profile: list[dict], policy: str = r"never quote|do not quote|drop") -> list[str]:
    """Patterns of the risk categories whose policy says that repeating the text is the harm."""
    return [p for c in profile for p in c.get("patterns", ()) if p.strip() and re.search(policy, str(c.get("policy", "")), re.I)]


_SPAN = re.compile(r"[「『“\"]([^「」『』“”\"]{2,})[」』”\"]")


def named_strings(findings: list[dict]) -> set[str]:
    """Texts that risk findings single out: their evidence, exemplars and samples, and what their reasons quote."""
    out: set[str] = set()
    for f in findings:
        out.update(str(x).strip() for k in ("evidence", "samples") for x in f.get(k) or ())
        out.add(str(f.get("exemplar") or "").strip())
        out.update(m.strip() for k in ("rationale", "risk_reason", "risk") for m in _SPAN.findall(str(f.get(k) or "")))
    return out - {""}


def never_quote_classes(nodes: list[dict], harm: str, declared: Iterable[str] = ()) -> set[str]:
    """Codes declared, and those of first-level nodes marked as risk whose own words match ``harm``."""
    words = lambda n: " ".join(str(n.get(k) or "") for k in ("name", "definition", "risk_note", "user_need"))
    return {x for x in declared if x.strip()} | {n["code"] for n in nodes if n.get("code") and n.get("risk") and n.get("level") in (None, 1) and re.search(harm, words(n), re.I)}


#: Characters a span needs to count as the beginning of a longer text.
FRAGMENT = 8


def printed_strings(documents: DataFrame, body: str, corpus: DataFrame, text: str) -> DataFrame:
    """Distinct corpus texts that documents show between quotation marks, whole or cut off after ``FRAGMENT`` characters or more."""
    spans = documents.select(F.explode(F.regexp_extract_all(body, F.lit(_SPAN.pattern), F.lit(1))).alias("span")).distinct()
    rows = corpus.where(F.col(text).isNotNull()).select(text).distinct()
    whole = rows.join(spans, F.col(text) == F.col("span"), "left_semi")
    # a beginning is met by its first characters, so no span is compared with all texts
    cut = spans.where(F.length("span") >= FRAGMENT).withColumn("_k", F.substring("span", 1, FRAGMENT))
    begun = rows.withColumn("_k", F.substring(text, 1, FRAGMENT)).join(cut, "_k").where(F.col(text).startswith(F.col("span"))).select(text)
    return whole.unionByName(begun).distinct()


def number_pool(table: DataFrame, places: int = 4) -> DataFrame:
    """Every number of the numeric columns in every spelling: rounded to 0 to ``places`` places, as it is, times 100 and by 100."""
    numeric = [f.name for f in table.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]
    if not numeric:
        raise ValueError("the table has no numbers, so every number of a text would be unmatched")
    v = table.select(F.explode(F.array(*[F.col(c).cast("double") for c in numeric])).alias("v")).where("v is not null and not isnan(v)").distinct()
    forms = []
    for k in range(places + 1):
        for scaled in (F.col("v"), F.col("v") * 100, F.col("v") / 100):
            forms.append(F.format_string(f"%.{k}f", F.round(scaled, k)))
    return v.select(F.explode(F.array_distinct(F.array(*forms))).alias("number")).select(F.when(F.col("number").contains("."), F.regexp_replace("number", r"\.?0+$", "")).otherwise(F.col("number")).alias("number")).distinct()


def unmatched_numbers(documents: DataFrame, unique: str, body: str, pool: DataFrame, years: tuple[str, ...] = ()) -> DataFrame:
    """(unique, number): numbers of a text, without thousands separators and closing zeros, that no table has."""
    found = documents.select(unique, F.explode(F.regexp_extract_all(body, F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0))).alias("_n"))
    plain = F.regexp_replace("_n", ",", "")
    found = found.select(unique, F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain).alias("number")).distinct()
    if years:
        found = found.where(~F.col("number").isin(*years))
    return found.join(pool, "number", "left_anti").select(unique, "number")


def bad_quotations(documents: DataFrame, unique: str, body: str, layered: DataFrame, text: str) -> DataFrame:
    """(unique, span, reason): quoted spans that are no corpus text, or one that the guard blocks wherever it occurs."""
    spans = documents.select(unique, F.explode(F.regexp_extract_all(body, F.lit(_SPAN.pattern), F.lit(1))).alias("span")).distinct()
    known = layered.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("span")).agg(F.max(F.col("quotable").cast("int")).alias("_ok"))
    j = spans.join(known, "span", "left")
    return j.select(unique, "span", F.when(F.col("_ok").isNull(), "not in the corpus").when(F.col("_ok") == 0, "guarded").alias("reason")).where("reason is not null")
