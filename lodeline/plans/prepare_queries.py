"""Queries of the preparation operators and text features over the search-side corpus and the query table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stats import positive
from ..operators import prepare as P
from ..session import table
from .queries import MAIN, query, r6

_TRIM = r"regexp_replace(query_raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


def _content(q: str) -> str:
    return rf"coalesce(regexp_matches({q}, '[\p{{L}}\p{{N}}]') and lower(regexp_replace({q}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) not in ('nan', 'none', '<na>', 'null'), false)"



def _start(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "prepared_corpus").select("row_id", "query_raw", "snapshot", "pv_raw")
    return P.start(c.withColumnRenamed("query_raw", "text").withColumnRenamed("pv_raw", "weight"), "text", "row_id", "weight")


@query("prep_trim_empty_length", f"""
with t as (select row_id, {_TRIM} query from prepared_corpus)
select row_id, query, case when not {_content("query")} then 'empty' when length(query) > 60 then 'long' else 'user' end tier from t""")
def prep_trim_empty_length(spark: SparkSession, d: str) -> DataFrame:
    x = P.length_filter(P.drop_empty(P.trim(_start(spark, d)), "empty"), most=60, tier="long")
    return x.select("row_id", "query", "tier")


@query("prep_dedup_tier", "with t as (select row_id, query_raw, row_number() over (partition by query_raw order by row_id) r from prepared_corpus) select row_id, case when query_raw is not null and r > 1 then 'repeat' else 'user' end tier from t")
def prep_dedup_tier(spark: SparkSession, d: str) -> DataFrame:
    return P.drop_duplicates(_start(spark, d), "repeat").select("row_id", "tier")


@query("prep_strip_prefix", r"""
select row_id, case when regexp_matches(query_raw, '^(?:请问|我想问|帮我查一下)') and length(regexp_replace(regexp_replace(query_raw, '^(?:请问|我想问|帮我查一下)', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 0
 then regexp_replace(regexp_replace(query_raw, '^(?:请问|我想问|帮我查一下)', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') else query_raw end query,
 coalesce(regexp_matches(query_raw, '^(?:请问|我想问|帮我查一下)') and length(regexp_replace(regexp_replace(query_raw, '^(?:请问|我想问|帮我查一下)', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 0, false) wrapper_stripped from prepared_corpus""")
def prep_strip_prefix(spark: SparkSession, d: str) -> DataFrame:
    return P.strip_prefix(_start(spark, d), "请问|我想问|帮我查一下").select("row_id", "query", "wrapper_stripped")


@query("prep_flag_and_drop_regex", """
select row_id, coalesce(regexp_matches(query_raw, 'pdf|下载'), false) flag_download, case when coalesce(regexp_matches(query_raw, '^第.{1,3}$|^page'), false) then 'fragment' else 'user' end tier from prepared_corpus""")
def prep_flag_and_drop_regex(spark: SparkSession, d: str) -> DataFrame:
    x = P.flag_regex(_start(spark, d), "pdf|下载", "download")
    return P.drop_regex(x, "^第.{1,3}$|^page", "fragment").select("row_id", "flag_download", "tier")


@query("prep_refused_removal", "select row_id, coalesce(length(query_raw) > 8, false) flag_refused_long, 'user' tier from prepared_corpus")
def prep_refused_removal(spark: SparkSession, d: str) -> DataFrame:
    """A removal of most rows is refused and becomes a flag."""
    return P.length_filter(_start(spark, d), most=8, tier="long").select("row_id", "flag_refused_long", "tier")


@query("prep_headcut_ties", f"""
with t as (select row_id, pv_raw, rank() over (order by pv_raw desc nulls last) r from prepared_corpus where pv_raw is not null),
n as (select count(*) n, count(pv_raw) k from prepared_corpus)
select row_id, case when r <= 500 then 'user' else 'head_cut' end tier from t""")
def prep_headcut_ties(spark: SparkSession, d: str) -> DataFrame:
    return P.head_cut(_start(spark, d).where("pv_raw is not null"), 500).select("row_id", "tier")


@query("prep_aggregate", "select query_raw query, sum(pv_raw) pv_raw, min(row_id) row_ord, count(*) n_rows_raw, arg_min(snapshot, row_id) snapshot from prepared_corpus group by query_raw")
def prep_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return P.aggregate_by_query(_start(spark, d)).select("query", "pv_raw", "row_ord", "n_rows_raw", "snapshot")


@query("prep_merge_collisions", f"with t as (select *, {_TRIM} q from prepared_corpus) select q query, sum(pv_raw) pv_raw, min(row_id) row_ord, count(*) n_rows_raw from t group by q")
def prep_merge_collisions(spark: SparkSession, d: str) -> DataFrame:
    return P.merge_collisions(P.trim(_start(spark, d))).select("query", "pv_raw", "row_ord", "n_rows_raw")


@query("prep_pv_norm", """
with t as (select row_id, snapshot, case when pv_raw > 0 and not isnan(pv_raw) then pv_raw end w from prepared_corpus),
s as (select snapshot, min(w) least_, sum(w) s, sum(case when w is null then 1 else 0 end) missing from t group by snapshot)
select row_id, round(coalesce(w, least_, 1) / (coalesce(s, 0) + missing * coalesce(least_, 1)) * 10000, 6) pv_norm from t join s using (snapshot)""")
def prep_pv_norm(spark: SparkSession, d: str) -> DataFrame:
    return r6(P.normalise(_start(spark, d)).select("row_id", "pv_norm"), "pv_norm")


@query("prep_plan_run")
def prep_plan_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole plan in order: trim, strip, merge, tier, normalise."""
    plan = [{"op": "trim"}, {"op": "strip_prefix", "pattern": "请问|你好，"}, {"op": "merge_collisions"}, {"op": "drop_empty"}, {"op": "length_filter", "most": 80, "reason": "pasted texts"}]
    done, _ = P.run_plan(_start(spark, d), plan)
    return P.normalise(done).select("row_id", "query", "snapshot", "n_rows_raw", "pv_norm")


@query("prep_superset_check", """
with t as (select row_id, query, round(pv_norm, 2) pv_norm, pv_norm full_ from prepared_corpus) select row_id, 'pv_norm' wrong from t where abs(pv_norm - full_) > 1e-9""")
def prep_superset_check(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "prepared_corpus").select("row_id", "query", "pv_norm")
    return P.superset_check(c.withColumn("pv_norm", F.round("pv_norm", 2)), c, ["row_id"], ["query", "pv_norm"])


@query("priority_tiers", f"""
select row_id, case when query is null or not {_content("query")} then 'S1_empty' when regexp_matches(query, '好累|tired') then 'S2_mood' when regexp_matches(query, '下载|download') then 'C1_download' when length(query) <= 3 then 'C2_short' else 'user' end tier from {MAIN}""")
def priority_tiers(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    rules = [("S1_empty", q.isNull() | ~X.has_content(q)), ("S2_mood", q.rlike("好累|tired")), ("C1_download", q.rlike("下载|download")), ("C2_short", F.length(q) <= 3)]
    return P.tiers(table(spark, d, MAIN).select("row_id", "query"), rules).select("row_id", "tier")


@query("content_free_and_headline_flags", f"""
select row_id, coalesce(regexp_matches(query, '^(?:嗯|的|少|继续|这个|ok|more|next|abc|b)$|^[0-9?.。]+$'), false) content_free, coalesce(not regexp_matches(query, '[?？吗哪谁怎什]|what|who|how|when|where|is ') and pv >= 100 and not isnan(pv), false) headline from {MAIN}""")
def content_free_and_headline_flags(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    free = q.rlike("^(?:嗯|的|少|继续|这个|ok|more|next|abc|b)$|^[0-9?.。]+$")
    headline = ~q.rlike("[?？吗哪谁怎什]|what|who|how|when|where|is ") & (F.col("pv") >= 100) & ~F.isnan("pv")
    return table(spark, d, MAIN).select("row_id", F.coalesce(free, F.lit(False)).alias("content_free"), F.coalesce(headline, F.lit(False)).alias("headline"))


@query("restore_dropped_rows", "select row_id, tier, case when tier = 'user' and not flag_headline then 'labelled' when tier <> 'user' then tier else 'not labelled' end reason from prepared_corpus")
def restore_dropped_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "prepared_corpus").select("row_id", "tier", "flag_headline")
    labelled = c.where("tier = 'user' and not flag_headline").select("row_id", F.lit("x").alias("label"))
    return P.restore_dropped(c, labelled, ["row_id"], "label").select("row_id", "tier", "reason")


@query("wrapper_prefix_counts", f"""
with t as (select query t from {MAIN} where length(query) >= 3), n as (select count(*) n from {MAIN}),
p as (select t[1:k] prefix, length(t) len from t, unnest(generate_series(3, least(length(t), 16))) u(k))
select prefix, count(*) n, min(len) shortest, round(count(*) / max(n.n)::double, 6) share from p, n group by prefix having count(*) >= 0.008e0 * max(n.n)""")
def wrapper_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    c = P.prefix_counts(table(spark, d, MAIN).select("query"), "query", min_share=0.008)
    return r6(c.withColumn("shortest", F.col("shortest").cast("bigint")), "share")


@query("wrapper_prefixes")
def wrapper_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The grown prefixes; from prefixes of 0.8 % of the rows or more, so at most a few hundred reach the driver."""
    counts = [(r.prefix, r.n, r.shortest) for r in P.prefix_counts(table(spark, d, MAIN).select("query"), "query", min_share=0.008).collect()]
    return spark.createDataFrame(P.wrapper_prefixes(counts), "prefix string, n bigint")


@query("input_profile", rf"""
select count(*) "rows", round(1 - count(distinct query) / count(query)::double, 6) duplicate_rate, round(quantile_cont(length(query), 0.5), 6) length_median, round(quantile_cont(length(query), 0.9), 6) length_p90,
 round(sum(length(regexp_replace(query, '[^\x{{4E00}}-\x{{9FFF}}]', '', 'g'))) / sum(length(query))::double, 6) han_share, round(sum(length(regexp_replace(query, '[^A-Za-z]', '', 'g'))) / sum(length(query))::double, 6) latin_share,
 round(avg(case when {_content("query")} then 0 else 1 end), 6) no_content_share from {MAIN}""")
def input_profile(spark: SparkSession, d: str) -> DataFrame:
    p = P.profile_input(table(spark, d, MAIN), "query")
    return r6(p, *[c for c in p.columns if c != "rows"])


@query("column_profiles", "".join(f"""{' union all ' if i else ''}select '{c}' "column", count(*) "rows", count(*) - count({c}) missing, count(distinct {c}) distinct_values, count(distinct {c}) <= 1 constant,
 round(avg(length({c}::varchar)), 6) mean_length, round(avg(case when {c} is not null then (try_cast({c}::varchar as double) is not null)::int end), 6) numeric_share from prepared_corpus""" for i, c in enumerate(("snapshot", "tier", "query_raw", "row_id"))))
def column_profiles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "prepared_corpus")
    out = P.profile_column(c, "snapshot", "row_id")
    for name in ("tier", "query_raw", "row_id"):
        out = out.unionByName(P.profile_column(c, name, "row_id"))
    return r6(out, "mean_length", "numeric_share")


@query("repeated_short_texts", f"select query text, count(*) n from {MAIN} where length(query) <= 12 group by query having count(*) >= 3 order by n desc, text limit 20")
def repeated_short_texts(spark: SparkSession, d: str) -> DataFrame:
    return P.repeated_short(table(spark, d, MAIN), "query")


# ---------------------------------------------------------------------------- text features

_RX = lambda p: f"length(regexp_replace(query, '[^{p}]', '', 'g'))"


@query("char_profile", rf"""
select row_id, length(query) len, {_RX("一-鿿㐀-䶿豈-﫿")} n_han, {_RX("A-Za-z")} n_lat, {_RX("0-9")} n_dig, length(regexp_replace(query, '[\p{{L}}\p{{N}}_\s]', '', 'g')) n_punct,
 length(query) - length(regexp_replace(query, '[ \t\n\x0b\f\r]', '', 'g')) n_space, round(case when length(query) > 0 then {_RX("一-鿿㐀-䶿豈-﫿")} / length(query)::double else 0 end, 6) r_han,
 regexp_matches(query, '[?？]') has_qmark, {_RX("一-鿿㐀-䶿豈-﫿")} > 0 and {_RX("A-Za-z")} > 0 is_mixed_script from {MAIN} where query is not null""")
def char_profile(spark: SparkSession, d: str) -> DataFrame:
    p = X.char_profile(F.col("query"))
    return r6(table(spark, d, MAIN).where("query is not null").select("row_id", *[p[k].cast("bigint").alias(k) for k in ("len", "n_han", "n_lat", "n_dig", "n_punct", "n_space")], p["r_han"].alias("r_han"), p["has_qmark"].alias("has_qmark"), p["is_mixed_script"].alias("is_mixed_script")), "r_han")


@query("script_profile", r"""
with t as (select doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) l, length(regexp_replace(text, '[^一-鿿㐀-䶿豈-﫿]', '', 'g')) h, length(regexp_replace(text, '[^\x{3040}-\x{30FF}]', '', 'g')) k, length(regexp_replace(text, '[^A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]', '', 'g')) a from documents)
select doc_id, round(case when l > 0 then h / l::double else 0 end, 6) han, round(case when l > 0 then k / l::double else 0 end, 6) kana, round(case when l > 0 then a / l::double else 0 end, 6) latin from t where l is not null""")
def script_profile(spark: SparkSession, d: str) -> DataFrame:
    s = X.script_shares(F.col("text"))
    return r6(table(spark, d, "documents").where("text is not null").select("doc_id", s["han"].alias("han"), s["kana"].alias("kana"), s["latin"].alias("latin")), "han", "kana", "latin")


@query("row_script_labels")
def row_script_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, MAIN).select("row_id", X.script_label(F.col("query")).alias("script"))


@query("corpus_audit", f"""
select own_run, count(*) "rows", count(distinct query) distinct_texts, round(1 - count(distinct query) / count(query)::double, 6) duplicate_rate, round(avg(length(query)), 6) len_mean, round(quantile_cont(length(query), 0.1), 6) p10, round(quantile_cont(length(query), 0.5), 6) p50,
 round(quantile_cont(length(query), 0.9), 6) p90, round(quantile_cont(length(query), 0.99), 6) p99, max(length(query)) len_max from {MAIN} group by own_run""")
def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("query")
    a = table(spark, d, MAIN).groupBy("own_run").agg(
        F.count("*").alias("rows"), F.count_distinct("query").alias("distinct_texts"), (1 - F.count_distinct("query") / F.count("query")).alias("duplicate_rate"), F.avg(n).alias("len_mean"),
        *[F.percentile(n, F.lit(q)).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9, 0.99)], F.max(n).cast("bigint").alias("len_max"),
    )
    return r6(a, "duplicate_rate", "len_mean", "p10", "p50", "p90", "p99")


@query("head_queries", f"select query, count(*) n from {MAIN} where query is not null group by query having count(*) > 1 order by n desc, query limit 30")
def head_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, MAIN).where("query is not null").groupBy("query").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "query").limit(30)


_RISK = {"contact": "@|电话|tel\\.|whatsapp", "identity": "身份证|证件号|national id|identity card", "place": "地址|收货|i live at|ship to"}


@query("risk_screen", "with t as (select query q, row_id from " + MAIN + ") " + " union all ".join(f"""
select '{k}' category, sum(h)::bigint hits, round(sum(h) / count(*)::double, 6) share, (select row_id from (select row_id, row_number() over (order by row_id) r, count(*) over () c from t where regexp_matches(q, '{p}')) where r = c // 2 + 1) exemplar from (select coalesce(regexp_matches(q, '{p}'), false)::int h from t)""" for k, p in _RISK.items()))
def risk_screen(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each category and the hit in the middle of the ids: the n-th smallest found by an exact percentile."""
    t = table(spark, d, MAIN)
    out = None
    for k, p in _RISK.items():
        hit = F.coalesce(F.col("query").rlike(p), F.lit(False))
        a = t.agg(F.sum(hit.cast("long")).alias("hits"), F.avg(hit.cast("int")).alias("share"))
        ids = t.where(hit).select("row_id")
        n = ids.count()
        place = ids.agg(F.percentile("row_id", F.lit((n // 2) / max(1, n - 1))).cast("bigint").alias("exemplar"))
        row = a.select(F.lit(k).alias("category"), "hits", "share").join(place, F.lit(True))
        out = row if out is None else out.unionByName(row)
    return r6(out, "share")


@query("quote_guard_layers", f"""
with t as (select coalesce(regexp_matches(query, '@|电话|tel\\.'), false) a, coalesce(regexp_matches(query, '身份证|national id'), false) b, coalesce(regexp_matches(query, '我叫') and regexp_matches(query, '地址'), false) c from {MAIN})
select sum(a::int)::bigint risk, sum(b::int)::bigint hard, sum(c::int)::bigint together, sum((a or b or c)::int)::bigint any_layer, sum((not (a or b or c))::int)::bigint quotable, count(*) total from t""")
def quote_guard_layers(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    no = F.lit(False)
    t = table(spark, d, MAIN).select(F.coalesce(q.rlike("@|电话|tel\\."), no).alias("a"), F.coalesce(q.rlike("身份证|national id"), no).alias("b"), F.coalesce(q.rlike("我叫") & q.rlike("地址"), no).alias("c"))
    any_ = F.col("a") | F.col("b") | F.col("c")
    s = lambda c: F.sum(c.cast("long"))
    return t.agg(s(F.col("a")).alias("risk"), s(F.col("b")).alias("hard"), s(F.col("c")).alias("together"), s(any_).alias("any_layer"), s(~any_).alias("quotable"), F.count("*").alias("total"))


@query("surface_form_table", f"""
select own_run, count(*) n, round(avg(coalesce(regexp_matches(query, '[?？]'), false)::int), 6) question_share, round(avg(coalesce(regexp_matches(query, '^(?:请问|你好|帮我|hello|can you|please)'), false)::int), 6) courtesy_share, round(quantile_cont(length(query), 0.5), 6) len_median from {MAIN} group by own_run""")
def surface_form_table(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    share = lambda p: F.avg(F.coalesce(q.rlike(p), F.lit(False)).cast("int"))
    return r6(table(spark, d, MAIN).groupBy("own_run").agg(F.count("*").alias("n"), share("[?？]").alias("question_share"), share("^(?:请问|你好|帮我|hello|can you|please)").alias("courtesy_share"), F.percentile(F.length(q), F.lit(0.5)).alias("len_median")), "question_share", "courtesy_share", "len_median")


@query("weight_positive_profile", f"select own_run, count(*) n, sum(case when pv > 0 and not isnan(pv) then 1 else 0 end)::bigint n_weighted, max(case when pv > 0 and not isnan(pv) then pv end) max_weight from {MAIN} group by own_run")
def weight_positive_profile(spark: SparkSession, d: str) -> DataFrame:
    w = positive(F.col("pv"))
    return table(spark, d, MAIN).groupBy("own_run").agg(F.count("*").alias("n"), F.count(w).alias("n_weighted"), F.max(w).alias("max_weight"))
