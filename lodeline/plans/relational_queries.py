"""Queries of the relational substrate: joins of every kind, windows, grouping sets, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relate as R
from ..sources import readers
from ..streaming import movement
from ..session import table
from .queries import MAIN, query, r6


@query("containment_wrap_join", f"""
with h as (select distinct core head from {MAIN} where core is not null and length(core) between 3 and 32 and not regexp_matches(core, '^[0-9]+$') and surface = 'assistant_top1k'),
t as (select row_id, query t from {MAIN} where query is not null and surface = 'search_top1000')
select row_id, arg_max(head, (length(head), head)) head from t join h on contains(t, head) and length(t) >= length(head) + 2 group by row_id""")
def containment_wrap_join(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, MAIN)
    heads = m.where("surface = 'assistant_top1k' and core is not null").select("core")
    return R.wrapped(m.where("surface = 'search_top1000' and query is not null"), heads, "query", "core", ["row_id"])


@query("verified_positional_join", "select p.row_id, p.query, p.tier, q.snapshot from prepared_corpus p join prepared_corpus q using (row_id)")
def verified_positional_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "prepared_corpus")
    return readers.verified_join(c.select("row_id", "query", "tier"), c.select("row_id", "query", "snapshot"), "row_id", "query").select("row_id", "query", "tier", "snapshot")


@query("baseline_diff_by_name", f"""
with r as (select own_run, row_number() over (order by own_run) o from (select distinct own_run from {MAIN} where own_run is not null)),
c as (select own_leaf, o, count(*) n from {MAIN} join r using (own_run) where own_leaf is not null and o <= 2 group by all), s as (select own_leaf, o, n / sum(n) over (partition by o)::double p from c)
select coalesce(a.own_leaf, b.own_leaf) own_leaf, round(a.p, 6) "before", round(b.p, 6) "after", case when a.p is null then 'appeared' when b.p is null then 'vanished' when b.p - a.p >= 0.005 then 'grown' when b.p - a.p <= -0.005 then 'shrunk' else 'same' end change
from (from s where o = 1) a full join (from s where o = 2) b on a.own_leaf = b.own_leaf""")
def baseline_diff_by_name(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.compare import snapshots_of

    m = table(spark, d, MAIN)
    a, b = snapshots_of(m, "own_run")[:2]
    c = lambda s: m.where((F.col("own_run") == s) & F.col("own_leaf").isNotNull()).groupBy("own_leaf").agg(F.count("*").alias("n"))
    return r6(R.diff_by_name(c(a), c(b), "own_leaf", "n"), "before", "after")


@query("coverage_report", "select distinct row_id, 'missing' problem from edu_label_votes v where row_id is not null and not exists (from gold_rows g where g.idx = v.row_id)")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    votes = table(spark, d, "edu_label_votes").where("row_id is not null").select("row_id").distinct()
    gold = table(spark, d, "gold_rows").select(F.col("idx").alias("row_id")).join(votes, "row_id", "left_semi").distinct()
    return R.coverage_report(votes, gold, "row_id")


@query("indistinguishable_leaves", f"select * from (select own_run family, own_leaf name, l2 leaf, count(*) n, count(*) over (partition by own_run, own_leaf) leaves from {MAIN} where l2 is not null group by own_run, own_leaf, l2) where leaves > 1")
def indistinguishable_leaves(spark: SparkSession, d: str) -> DataFrame:
    return R.indistinguishable(table(spark, d, MAIN), "l2", "own_run", "own_leaf")


@query("pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(avg(l_discount), 6) avg_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("revenue_by_nation_and_year", """
select n_name, year(o_orderdate)::int y, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all""")
def revenue_by_nation_and_year(spark: SparkSession, d: str) -> DataFrame:
    l, o, c, n = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "nation"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nations: 25 rows
    return j.groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("customers_without_urgent_orders", "select c_custkey, c_mktsegment from customer c where not exists (from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')")
def customers_without_urgent_orders(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


@query("grouping_sets_of_labels", f"select own_run, own_leaf, l2, count(*) n from {MAIN} where own_leaf is not null and l2 is not null group by grouping sets ((own_run), (own_run, own_leaf), (own_run, own_leaf, l2), ())")
def grouping_sets_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """Four label levels in one scan."""
    m = table(spark, d, MAIN).where("own_leaf is not null and l2 is not null")
    return m.groupingSets([["own_run"], ["own_run", "own_leaf"], ["own_run", "own_leaf", "l2"], []], "own_run", "own_leaf", "l2").agg(F.count("*").alias("n"))


@query("pivot_runs", f"""
with r as (select own_run, row_number() over (order by own_run) o from (select distinct own_run from {MAIN} where own_run is not null))
select own_leaf, sum((o = 1)::int)::bigint run1, sum((o = 2)::int)::bigint run2, sum((o = 3)::int)::bigint run3 from {MAIN} join r using (own_run) where own_leaf is not null group by own_leaf""")
def pivot_runs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.compare import snapshots_of

    m = table(spark, d, MAIN).where("own_leaf is not null")
    runs = snapshots_of(m, "own_run")[:3]
    p = m.groupBy("own_leaf").pivot("own_run", runs).count()
    return p.select("own_leaf", *[F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias(f"run{i + 1}") for i, r in enumerate(runs)])


@query("event_gaps", "select * from (select event_id, user_id, epoch(ts - lag(ts) over (partition by user_id order by ts, event_id))::bigint gap_s from events) where gap_s is not null")
def event_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return table(spark, d, "events").select("event_id", "user_id", F.round(gap / 1_000_000).cast("bigint").alias("gap_s")).where("gap_s is not null")


@query("event_windows", "select strftime(date_trunc('day', ts), '%Y-%m-%d') \"day\", event_type cls, count(*) n from events group by all")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    c = movement.class_counts(table(spark, d, "events"), "ts", "event_type")
    return c.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "cls", "n")


@query("event_sessions", """
with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minutes then 1 else 0 end b from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) s from g) select user_id "key", count(*) n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') start from s group by user_id, s""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = movement.sessions(table(spark, d, "events"), "ts", "user_id")
    return s.select("key", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("pooled_inputs", "select query, 'a' snapshot from prepared_corpus where query is not null union all select query, 'b' from sva_dom_edu_wraps_head where query is not null")
def pooled_inputs(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "prepared_corpus").where("query is not null"), table(spark, d, MAIN).where("query is not null")
    return readers.pool([("a", a), ("b", b)])[0].select("query", "snapshot")


@query("canonical_frame", "select row_number() over (order by row_id) - 1 row_id, query, length(query) len, pv_raw weight, snapshot, tier from prepared_corpus where query is not null")
def canonical_frame(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "prepared_corpus").where("query is not null")
    f = readers.build_frame(c, "query", "pv_raw", "snapshot", ("tier",), "row_id")
    return f.select("row_id", "query", F.col("len").cast("bigint").alias("len"), "weight", "snapshot", "tier")


@query("label_like_columns")
def label_like_columns(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in readers.label_like_columns(table(spark, d, MAIN))], "column string")
