"""Queries of the quote guard and of report checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guard as G
from ..session import table
from .queries import MAIN, query

GUARD = G.Guard(
    hard={"mail": "@", "long number": "[0-9]{8}", "identity": "身份证|national id"},
    together=(("我叫", "地址"), ("my name", "address")),
    declared=("答案请寄", "(?i)ship to"),
    classes=("mood talk",),
)


def _layered(spark: SparkSession, d: str) -> DataFrame:
    """Risk rows are those with a phone sign, named texts those the gold readers adjudicated, screened ones the corpus's headlines."""
    rows = table(spark, d, MAIN).select("row_id", "query", "own_leaf", "own_run")
    named = table(spark, d, "gold_rows").where("adjudicated").select("query")
    screened = table(spark, d, "prepared_corpus").where("flag_headline").select("query")
    return G.layers(rows, "row_id", "query", "own_leaf", GUARD, rows.where(F.col("query").rlike("电话|打给我|tel")).select("row_id"), named, screened)


def _hit(p: str) -> str:
    return f"coalesce(regexp_matches(query, '{p}'), false)"


_LAYERED = f"""
with t as (select row_id, query, own_leaf, own_run, {_hit('电话|打给我|tel')} risk, {' or '.join(_hit(p) for p in GUARD.hard.values())} hard, {' or '.join(f"({_hit(a)} and {_hit(b)})" for a, b in GUARD.together)} together,
 coalesce(query in (select query from gold_rows where adjudicated and query is not null), false) named, coalesce(own_leaf = 'mood talk', false) class, {' or '.join(_hit(p) for p in GUARD.declared)} declared,
 coalesce(query in (select query from prepared_corpus where flag_headline and query is not null), false) screened from {MAIN}),
l as (select *, risk or hard or together or named or class or declared or screened blocked, not (risk or hard or together or named or class or declared or screened) and query is not null quotable from t)"""


@query("quote_guard_counts", _LAYERED + " ".join(" union all"[: 10 * bool(i)] + f" select '{n}' layer, coalesce(sum(({c})::int), 0)::bigint n from l" for i, (n, c) in enumerate([*[(x, x) for x in G.LAYERS], ("any", "blocked"), ("quotable", "quotable"), ("all", "true")])))
def quote_guard_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.counts(_layered(spark, d))


@query("quotable_rows", _LAYERED + " select row_id from l where quotable")
def quotable_rows(spark: SparkSession, d: str) -> DataFrame:
    return _layered(spark, d).where("quotable").select("row_id")


@query("hard_rule_scan", " union all ".join(f"select distinct '{k}' rule, query, own_run, query in (select query from gold_rows where query is not null) printed from {MAIN} where regexp_matches(query, '{p}')" for k, p in GUARD.hard.items()))
def hard_rule_scan(spark: SparkSession, d: str) -> DataFrame:
    return G.hard_rule_scan(table(spark, d, MAIN), "query", "own_run", GUARD, table(spark, d, "gold_rows").where("query is not null").select("query"))


_SPANS = "select distinct doc_id, unnest(regexp_extract_all(text, '[「『“\"]([^「」『』“”\"]{2,})[」』”\"]', 1)) span from documents"


@query("printed_corpus_strings", f"""
with s as (select distinct span from ({_SPANS})), r as (select distinct query from {MAIN} where query is not null)
select query from r where query in (select span from s) union select query from r join s on substring(query, 1, 8) = substring(span, 1, 8) and starts_with(query, span) where length(span) >= 8""")
def printed_corpus_strings(spark: SparkSession, d: str) -> DataFrame:
    return G.printed_strings(table(spark, d, "documents"), "text", table(spark, d, MAIN), "query")


@query("bad_quotations", _LAYERED + f""", k as (select query span, max(quotable::int) ok from l where query is not null group by query), s as ({_SPANS})
select doc_id, span, case when ok is null then 'not in the corpus' else 'guarded' end reason from s left join k using (span) where ok is null or ok = 0""")
def bad_quotations(spark: SparkSession, d: str) -> DataFrame:
    return G.bad_quotations(table(spark, d, "documents"), "doc_id", "text", _layered(spark, d), "query")


@query("unmatched_report_numbers", """
with v as (select distinct n_chars::bigint v from documents where n_chars is not null union select distinct doc_id from documents),
pool as (select v::varchar number from v union select (v * 100)::varchar from v union select ((v + 50) // 100)::varchar from v),
f as (select distinct doc_id, replace(unnest(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?')), ',', '') n from documents where kind = 'run_report'),
g as (select distinct doc_id, case when contains(n, '.') then regexp_replace(n, '\\.?0+$', '') else n end number from f)
select doc_id, number from g where number not in (select number from pool)""")
def unmatched_report_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of run reports that are in no spelling a number of the documents table."""
    docs = table(spark, d, "documents")
    return G.unmatched_numbers(docs.where("kind = 'run_report'"), "doc_id", "text", G.number_pool(docs.select("doc_id", "n_chars"), 0))
