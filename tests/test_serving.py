"""Quote guard, report checks, served answers and comparison of partitions."""

import pytest
from pyspark.sql import functions as F

from lodeline.operators import guard as G
from lodeline.operators import panel as P
from lodeline.operators import serve as S

GUARD = G.Guard(hard={"mail": "@"}, together=(("我叫", "地址"),), declared=("secret",), classes=("risky",))
ROWS = [(1, "write a@b.example", "x", "A"), (2, "我叫王芳，地址青山路", "x", "A"), (3, "我叫王芳", "x", "B"), (4, "a secret", None, "B"), (5, "fine", "risky", "A"), (6, None, "x", "A"), (7, "listed text", "x", None), (8, "screened text", "x", "A"), (9, "good text", "x", "A"), (9, "good text", "x", "A")]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "row_id long, query string, cls string, snap string")


def test_each_layer_blocks_for_its_own_reason(spark, rows):
    text = lambda *x: spark.createDataFrame([(v,) for v in x], "query string")
    got = G.layers(rows, "row_id", "query", "cls", GUARD, rows.where("row_id = 3").select("row_id"), text("listed text", None), text("screened text", "screened text"))
    by = {r.row_id: [c for c in G.LAYERS if r[c]] for r in got.collect()}
    assert by == {1: ["hard"], 2: ["together"], 3: ["risk"], 4: ["declared"], 5: ["class"], 6: [], 7: ["named"], 8: ["screened"], 9: []}
    assert [r.row_id for r in got.where("quotable").collect()] == [9, 9] and got.count() == len(ROWS)
    n = {r.layer: r.n for r in G.counts(got).collect()}
    assert n == {"risk": 1, "hard": 1, "together": 1, "named": 1, "class": 1, "declared": 1, "screened": 1, "any": 7, "quotable": 2, "all": 10}
    assert {r.layer: r.n for r in G.counts(got.limit(0)).collect()}["all"] == 0


def test_bad_patterns_are_named(spark):
    with pytest.raises(ValueError, match="unclosed"):
        G.compiled(spark, ["fine", "(unclosed"])


def test_hard_scan_and_printed_texts(spark, rows):
    got = G.hard_rule_scan(rows, "query", "snap", GUARD, spark.createDataFrame([("write a@b.example",)], "query string"))
    assert [tuple(r) for r in got.collect()] == [("mail", "write a@b.example", "A", True)]
    docs = spark.createDataFrame([(1, 'says “good text” and "screened t" and 「fin」'), (2, None)], "doc_id long, text string")
    assert {r.query for r in G.printed_strings(docs, "text", rows, "query").collect()} == {"good text", "screened text"}


def test_what_profiles_and_findings_say():
    profile = [{"policy": "Never quote", "patterns": ["a", " "]}, {"policy": "route first", "patterns": ["b"]}]
    assert G.patterns_to_guard(profile) == ["a"]
    assert G.named_strings([{"evidence": ["x "], "rationale": "because of 「the row」", "exemplar": None, "samples": ["y"]}]) == {"x", "the row", "y"}
    nodes = [{"code": "A", "risk": True, "level": 1, "definition": "explicit image editing"}, {"code": "B", "risk": True, "level": 2, "name": "explicit"}, {"code": "C", "name": "explicit"}]
    assert G.never_quote_classes(nodes, "explicit", ["D", " "]) == {"A", "D"}


def test_report_numbers_and_quotations(spark, rows):
    table = spark.createDataFrame([(1234, 0.4567), (10, None)], "n long, share double")
    pool = G.number_pool(table)
    docs = spark.createDataFrame([(1, "1,234 rows, 45.67 %, 0.46, 0.457, 10.0; but 99 and 2024"), (2, "“good text” “我叫王芳，地址青山路” “never said”"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in G.unmatched_numbers(docs, "doc_id", "text", pool, ("2024",)).collect()] == [(1, "99")]
    bad = G.bad_quotations(docs, "doc_id", "text", G.layers(rows, "row_id", "query", "cls", GUARD), "query")
    assert {tuple(r) for r in bad.collect()} == {(2, "我叫王芳，地址青山路", "guarded"), (2, "never said", "not in the corpus")}
    with pytest.raises(ValueError):
        G.number_pool(table.select(F.lit("x").alias("t")))


def test_answers(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None, "late" if i < 300 else "early", float(i % 7)) for i in range(600)], "row_id long, cls string, snap string, w double")
    tables = S.comparison(rows, ["cls"], "snap", F.col("w"))
    assert set(tables) == {f"{k}_cls" for k in ("matrix", "change", "distance", "absence", "coverage")}
    d = {r.snap: r for r in S.class_detail(tables, "cls", "a").collect()}
    assert set(d) == {"early", "late"} and not d["late"].absent and d["late"].lo < d["late"].p < d["late"].hi
    with pytest.raises(ValueError, match="no class"):
        S.class_detail(tables, "cls", "zzz")
    assert S.findings(tables, "cls").count() == 0  # the snapshots are alike
    out = S.scrub(spark.createDataFrame([("x@y", float("nan")), (None, float("inf")), ("ok", 1.0)], "t string, v double"), GUARD, spark.createDataFrame([("ok",)], "s string")).collect()
    assert {tuple(r) for r in out} == {(S.BLOCKED, None), (None, None), (S.BLOCKED, 1.0)}


def test_small_tables_of_reviews(spark):
    gold = spark.createDataFrame([(i, "B" if i % 2 else "A", "A" if i % 2 else "B") for i in range(40)] + [(99, "A", "A"), (98, None, "A")], "id long, a string, b string")
    got = S.disagreement_batches(gold, "id", "a", "b", 15).groupBy("class_a", "class_b", "batch").count().collect()
    assert {(r.class_a, r.class_b, r.batch, r["count"]) for r in got} == {("A", "B", 0, 15), ("A", "B", 1, 15), ("A", "B", 2, 10)}
    t = spark.createDataFrame([("k", "x", 1.0), ("k", "y", 3.0), ("k", "x", 2.5), ("j", "z", None)], "key string, label string, w double")
    assert {tuple(r) for r in S.dominant_label(t, "key", "label", F.col("w")).collect()} == {("k", "x", True), ("j", "z", False)}
    assert S.shared_texts(spark.createDataFrame([("f", "t"), ("g", "t"), ("g", "u"), ("f", "t"), (None, "t")], "s string, t string"), "s", "t").collect() == [("f", "g", 1, 2, 1)]


def test_margins_locators_and_panels():
    rows = [{"algorithm": "kmeans", "k": 5, "stability": 0.8}, {"algorithm": "bisecting", "k": 5, "stability": 0.7}, {"algorithm": "ward", "k": 5, "stability": 0.95}, {"algorithm": "ward", "k": 9, "stability": 0.99}]
    assert P.battery_verdict(rows)["contradicted"] and abs(P.paired_margins(rows)[5] - 0.15) < 1e-12
    assert P.battery_verdict(rows[:2]) == {"margins": {}, "contradicted": None}
    sweep = [{"k": k, "x": 0.5 - 0.02 * abs(k - 8) + 0.001 * (k % 2), "y": 0.5 + 0.01 * (k % 2)} for k in range(4, 14)]
    reach = {"x": {"column": "x", "reach": 0.9}, "y": {"column": "y", "reach": 1.0}, "z": {"column": "x", "reach": 0.3}}
    assert P.choose_locator(reach, sweep) == "x" and P.choose_locator({}, sweep) is None
    assert P.reference_sensitivity(sweep, ["x", "y"]) == {"k": {"x": 8, "y": 5}, "agree": False}
    assert P.stability_with_error([0.5, 0.7])["mean"] == 0.6 and P.stability_with_error([0.5])["sem"] == 0
    p = P.Panel()
    p.record("a", {"purity": 0.5, "fragmentation": 3.0, "silhouette": 0.9})
    p.record("b", {"purity": 0.7, "fragmentation": 2.0, "silhouette": float("nan")})
    assert p.ranking("purity")[0][0] == "b" and p.ranking("fragmentation")[0][0] == "b" and len(p.table()) == 2
    with pytest.raises(ValueError):
        p.ranking("silhouette")
    p.seed = 1
    p.record("c", {"purity": 0.1})
    with pytest.raises(ValueError):
        p.table()
    assert P.governance_ledger([{"id": 1, "kind": "merge", "targets": [2, 3]}])[0]["targets"] == "2, 3"


def test_leaves_split_only_into_large_halves(spark):
    rows = [(i, [1.0, 0.01 * (i % 5), 0.0] if i % 2 else [0.0, 0.01 * (i % 5), 1.0]) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    parts = {r.id: r.part for r in P.split_leaf(df, "v", "id").collect()}
    assert len({parts[i] for i in range(0, 160, 2)}) == 1 and len({parts[i] for i in range(1, 160, 2)}) == 1 and parts[0] != parts[1]
    assert P.split_leaf(df.limit(100), "v", "id") is None
