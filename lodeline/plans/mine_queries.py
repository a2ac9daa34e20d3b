"""Queries of the mining operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mine as M
from ..session import table
from .queries import MAIN, query, r6

_GROUPS = [M.Group("audio", "音频|audio", True), M.Group("lesson", "教案|lesson plan", True), M.Group("mock", "模拟|mock"), M.Group("download", "下载|download|pdf"), M.Group("score", "分数|录取|score")]


def _sql_affixes(source: str, column: str, least: int) -> str:
    return rf"""
with t as (select regexp_replace({column}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') t from {source} where {column} is not null),
e as (select t, k from t, unnest(generate_series(2, least(length(t) - 1, 6))) u(k) where length(t) > 2),
a as (select 'prefix' side, substring(t, 1, k::int) affix from e union all select 'suffix', substring(t, (length(t) - k + 1)::int, k::int) from e)
select side, affix, count(*) n, count(*) * length(affix) score from a group by side, affix having count(*) >= {least}"""


@query("affix_mining_queries", _sql_affixes(MAIN, "query", 60))
def affix_mining_queries(spark: SparkSession, d: str) -> DataFrame:
    return M.affixes(table(spark, d, MAIN), "query")


@query("affix_mining_part", _sql_affixes("part", "p_name", 20))
def affix_mining_part(spark: SparkSession, d: str) -> DataFrame:
    return M.affixes(table(spark, d, "part"), "p_name", least=20)


@query("affixes_without_nested")
def affixes_without_nested(spark: SparkSession, d: str) -> DataFrame:
    """The greedy end of affix mining over all affixes of 60 texts or more; refused beyond 200,000 of them."""
    rows = [(r.affix, r.n) for r in M.affixes(table(spark, d, MAIN), "query").orderBy(F.col("score").desc(), "affix").limit(200_001).collect()]
    if len(rows) > 200_000:
        raise ValueError("more than 200,000 affixes: raise the least number of texts")
    return spark.createDataFrame(M.drop_subsumed(rows), "affix string, n bigint")


@query("template_coverage", "with t as (select " + ", ".join(f"coalesce(regexp_matches(query, '{g.pattern}'), false) {g.name}_" for g in _GROUPS) + f" from {MAIN}) select 'any' grp, sum(({' or '.join(g.name + '_' for g in _GROUPS)})::int)::bigint n, round(avg(({' or '.join(g.name + '_' for g in _GROUPS)})::int), 6) share, case when avg(({' or '.join(g.name + '_' for g in _GROUPS)})::int) < 0.2 then 'too low' when avg(({' or '.join(g.name + '_' for g in _GROUPS)})::int) > 0.4 then 'too high' else 'in window' end verdict from t"
       + "".join(f" union all select '{g.name}', sum({g.name}_::int)::bigint, round(avg({g.name}_::int), 6), null from t" for g in _GROUPS))
def template_coverage(spark: SparkSession, d: str) -> DataFrame:
    return r6(M.coverage(table(spark, d, MAIN), "query", _GROUPS), "share")


@query("template_masks", " union all ".join(f"select row_id, '{g.name}' grp from {MAIN} where regexp_matches(query, '{g.pattern}')" for g in _GROUPS))
def template_masks(spark: SparkSession, d: str) -> DataFrame:
    return M.masks(table(spark, d, MAIN), "query", _GROUPS, ["row_id"])


@query("template_groups_built")
def template_groups_built(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, MAIN)
    built = M.build_groups(rows, "query", _GROUPS)
    chosen = {g.name for g in M.select_for_coverage(rows, "query", built)}
    return spark.createDataFrame([(g.name, g.pattern, g.seed, g.name in chosen) for g in built], "grp string, pattern string, seed boolean, chosen boolean")


_FRAG = "with m as (" + " union all ".join(f"select row_id, '{g.name}' grp, rank_ c from (select row_id, query, dense_rank() over (order by u_ds) rank_ from {MAIN} where u_ds is not null) where regexp_matches(query, '{g.pattern}')" for g in _GROUPS) + """),
c as (select grp, c, count(*) n from m group by all), x as (select *, sum(n) over (partition by grp)::double t from c),
f as (select grp, max(t)::bigint members, exp(-sum(n/t*ln(n/t))) effective, count(*) clusters from x where t >= 30 group by grp)"""


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, MAIN).where("u_ds is not null")
    codes = rows.select("u_ds").distinct()  # codes of a labeller: a few dozen spellings
    from pyspark.sql import Window

    ranked = codes.withColumn("c", F.dense_rank().over(Window.orderBy("u_ds")))
    return rows.join(F.broadcast(ranked), "u_ds")


@query("template_fragmentation", _FRAG + " select grp, members, round(effective, 6) effective, clusters from f")
def template_fragmentation(spark: SparkSession, d: str) -> DataFrame:
    m = M.masks(_clustered(spark, d), "query", _GROUPS, ["row_id", "c"])
    return r6(M.fragmentation(m, "grp", "c"), "effective")


@query("template_fragmentation_adjusted", _FRAG + f""", g as (select u_ds, count(*)::double n from {MAIN} where u_ds is not null group by u_ds), e as (select exp(-sum(n/t*ln(n/t))) expected from g, (select sum(n) t from g))
select grp, members, round(effective, 6) effective, clusters, round(expected, 6) expected, round((expected - effective) / (expected - 1), 6) adjusted from f, e""")
def template_fragmentation_adjusted(spark: SparkSession, d: str) -> DataFrame:
    rows = _clustered(spark, d)
    m = M.masks(rows, "query", _GROUPS, ["row_id", "c"])
    return r6(M.adjusted_fragmentation(M.fragmentation(m, "grp", "c"), rows, "c"), "effective", "expected", "adjusted")


@query("template_spread", "with m as (" + " union all ".join(f"select row_id, '{g.name}' grp, own_leaf cluster from {MAIN} where own_leaf is not null and regexp_matches(query, '{g.pattern}')" for g in _GROUPS) + """),
c as (select grp, cluster, count(*) n from m group by all), x as (select *, sum(n) over (partition by grp)::bigint members, count(*) over (partition by grp) touched, row_number() over (partition by grp order by n desc, cluster) r from c)
select grp, members, touched, r, cluster, round(n / members::double, 6) share from x where members >= 20 and r <= 5""")
def template_spread(spark: SparkSession, d: str) -> DataFrame:
    m = M.masks(table(spark, d, MAIN), "query", _GROUPS, ["row_id", "own_leaf"])
    return r6(M.template_spread(m, "grp", "own_leaf"), "share")


@query("distinctive_ngrams", f"""
with rows_ as (select row_number() over () i, own_leaf grp, query t from {MAIN} where query is not null and own_leaf is not null),
g as (select distinct i, grp, substring(t, p::int, k::int) gram from rows_, unnest([2, 3, 4]) u(k), unnest(generate_series(1, length(t) - k + 1)) v(p) where length(t) >= k),
s as (select grp, count(*) n_grp from rows_ group by grp), c as (select grp, gram, count(*) n from g group by all), a as (select gram, sum(n) n_all from c group by gram), tt as (select count(*)::double total from rows_)
select c.grp, c.gram, n, round(n / n_grp::double, 6) rate, round(n / n_grp::double / (n_all / total), 6) lift, round((n / n_grp::double) * (n / n_grp::double) / (n_all / total), 6) score from c join s using (grp) join a using (gram), tt where n >= greatest(3e0, 0.03e0 * n_grp)""")
def distinctive_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return r6(M.distinctive_grams(table(spark, d, MAIN), "query", "own_leaf"), "rate", "lift", "score")


def _sql_odds(source: str, text: str, side: str, a: str, b: str, distinct: bool) -> str:
    words = r"regexp_extract_all(lower(" + text + r"), '[\p{L}\p{N}_]+')"
    return f"""
with r as (select {side} s, unnest({f'list_distinct({words})' if distinct else words}) word from {source} where {text} is not null and {side} in ('{a}', '{b}')),
c as (select word, sum((s = '{a}')::int)::double ya, sum((s = '{b}')::int)::double yb from r group by word), n as (select sum(ya) na, sum(yb) nb from c),
x as (select *, 500 * (ya + yb) / (na + nb) al from c, n), y as (select *, ln((ya + al) / (na + 500 - ya - al)) - ln((yb + al) / (nb + 500 - yb - al)) delta from x)
select word, ya, yb, round(delta, 6) delta, round(delta / sqrt(1 / (ya + al) + 1 / (yb + al)), 6) z from y"""


@query("log_odds_words", _sql_odds("documents", "text", "kind", "run_report", "study_note", False))
def log_odds_words(spark: SparkSession, d: str) -> DataFrame:
    return r6(M.log_odds(table(spark, d, "documents"), "text", "kind", "run_report", "study_note"), "delta", "z")


@query("log_odds_by_document", _sql_odds("documents", "text", "kind", "adjudication", "class_card", True))
def log_odds_by_document(spark: SparkSession, d: str) -> DataFrame:
    return r6(M.log_odds(table(spark, d, "documents"), "text", "kind", "adjudication", "class_card", by_document=True), "delta", "z")


@query("discriminating_markers")
def discriminating_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers of every pair of classes the two readers of the gold rows confused, over all agreed rows."""
    gold = table(spark, d, "gold_rows").where("query is not null and final_label is not null")
    pairs = sorted({tuple(sorted((r.label_a, r.label_b))) for r in gold.where("label_a <> label_b").select("label_a", "label_b").distinct().collect()})
    out = M.pair_markers(gold.where("agreed"), "query", "final_label", pairs)
    return spark.createDataFrame(out, "class_a string, class_b string, marker string, points_to string, gain int, default_class string")
