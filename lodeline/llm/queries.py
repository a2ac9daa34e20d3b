"""The pN_ queries: each operator over its whole intended tables, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, table
from . import clusters, consensus, copies, language, lookalike, mixing, neighbours, private, tokens, topn

MAIN = "sva_dom_edu_wraps_head"

#: Setting of the session that holds the key of the pseudonyms; without it a key is drawn for the call, so pseudonyms link its rows alone.
KEY_SETTING = "spark.lodeline.pseudonym.key"


def _key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return private.find_private(table(spark, d, MAIN), "row_id", "query").select("row_id", "kind", "start_pos")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return private.redact(table(spark, d, MAIN).select("row_id", "query"), "query", "redacted", _key(spark))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: whether equal values have equal pseudonyms over all rows, and different ones different."""
    return private.links(table(spark, d, MAIN), "row_id", "query", _key(spark))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, MAIN).where("surface is not null and own_run is not null and pv > 0 and not isnan(pv)")
    once = topn.first_delivery(rows, "rec_key", "row_id", ["pv", "rank", "surface", "own_run"])
    order = [F.col("pv").desc(), F.col("rank").asc_nulls_last(), F.col("row_id").asc()]
    return topn.top_n(once, ["surface", "own_run"], order, 3, ["row_id", "pv", "rank"]).select("surface", "own_run", "row_id", "place")


def _label_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "edu_label_votes"), table(spark, d, MAIN), table(spark, d, "edu_crosswalk")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.found(*_label_tables(spark, d)).select("row_id", "u_code")


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.judge(*_label_tables(spark, d)).select("row_id", "u_code", F.round("confidence", 6).alias("confidence"), F.round("agreement", 6).alias("agreement"), "n_labels")


def p3_reliability(spark: SparkSession, d: str) -> DataFrame:
    votes, main, crosswalk = _label_tables(spark, d)
    _, m = consensus.solve(votes, main, crosswalk)
    return consensus.reliability(m, votes, [f"U{k + 1:02d}" for k in range(consensus.CLASSES)])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.find_disguised(table(spark, d, MAIN), "query", "nn_query").select("row_id")


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, MAIN).select("row_id", "query", "nn_query")
    return lookalike.unify(rows, {"query": "query_form", "nn_query": "nn_query_form"})


def p5_similar(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar(table(spark, d, "edu_query_vectors"), "vec_id", "vec", 64, 5, 0.8)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_similar(spark, d).select("vec_id", "place", "nn_vec_id")


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Exact lists of the vectors whose id is divisible by 20, their rows, and whether the operator finds 99 % of these."""
    vectors = table(spark, d, "edu_query_vectors")
    exact = materialise(neighbours.exact_lists(vectors, "vec_id", "vec", 64, 5, 0.8).select("vec_id", "place", "nn_vec_id"))
    met = exact.join(p5_found(spark, d).withColumn("_hit", F.lit(1)), ["vec_id", "place", "nn_vec_id"], "left")
    enough = F.coalesce(F.sum("_hit"), F.lit(0)) >= 0.99 * F.count("*")
    return met.agg(F.count_distinct("vec_id").alias("n_queries"), F.count("*").alias("n_rows"), F.sum("nn_vec_id").cast("bigint").alias("sum_of_ids"), enough.alias("recall_99"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.find_copies(table(spark, d, MAIN).select("row_id", "own_run", "pv", "query"), "row_id", ["own_run", "pv"], "query")


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, MAIN).select("row_id", "own_run", "pv", "query"), "row_id", ["own_run", "pv"], "query")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.find_members(table(spark, d, MAIN), "row_id", "own_run", "query", "core", "own_leaf")


def p7_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.describe(table(spark, d, MAIN), "row_id", "own_run", "query", "core", "own_leaf")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(p8_ids(spark, d), "doc_id", "ids")


def _mixed(spark: SparkSession, d: str, budget: float | str | None = "all") -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    docs = table(spark, d, "documents").select("doc_id", "source", "text").join(F.broadcast(targets.select("source")), "source", "left_semi")
    sized = materialise(tokens.count(docs, "text", "n_tokens"))
    return mixing.mix(sized, "source", "n_tokens", "doc_id", targets, budget)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix with as many tokens as all listed sources together: sources short of their target are clamped, the rest water-fills."""
    return _mixed(spark, d)[0].select("doc_id", "source", "n_tokens", "copies")


def p9_mix_on_target(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix in which every source with documents reaches its target; the scarcest source limits it."""
    return _mixed(spark, d, None)[0].select("doc_id", "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_shares_on_target(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, None)[1]


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.judge_rows(table(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id", "segment", "lang", F.round("confidence", 6).alias("confidence"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.find_wrong(language.judge_rows(table(spark, d, "documents"), "doc_id", "text", "lang")).select("doc_id", "segment", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}
