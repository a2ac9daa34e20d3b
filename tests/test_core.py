"""Semantics, refusals and SQL parity of the core operators."""

import glob
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from lodeline.functions import stats, text
from lodeline.operators import checks, cluster, compare, labels, mine, prepare, relate, sampling, select, vectors
from lodeline.plans import queries
from lodeline.sources import readers, store
from lodeline.streaming import movement

SMALL = "/root/testdata/sf0.001"


def test_wilson_and_newcombe(spark):
    df = spark.createDataFrame([(5, 10, 9, 10), (0, 0, 1, 10), (0, 10, 10, 10)], "a long, n long, b long, m long")
    lo, hi = stats.wilson(F.col("a"), F.col("n"))
    d, dl, dh = stats.newcombe(F.col("a"), F.col("n"), F.col("b"), F.col("m"))
    r = df.select(lo.alias("lo"), hi.alias("hi"), d.alias("d"), dl.alias("dl"), dh.alias("dh")).collect()
    assert abs(r[0].lo - 0.2366) < 1e-3 and abs(r[0].hi - 0.7634) < 1e-3 and (r[1].lo, r[1].hi) == (0, 0)
    assert r[0].dl < 0.4 < r[0].dh and abs(r[2].d - 1) < 1e-12


@pytest.mark.parametrize(("q", "ok"), [("abc", True), ("中", True), (" nan ", False), ("...", False), ("", False), (None, False), ("7", True)])
def test_has_content(spark, q, ok):
    assert spark.createDataFrame([(q,)], "q string").select(text.has_content(F.col("q")).alias("x")).head().x == ok


def test_script_labels(spark):
    df = spark.createDataFrame([("你好",), ("hello",), ("你好abc",), ("123",), (None,)], "q string")
    assert [r.s for r in df.select(text.script_label(F.col("q")).alias("s")).collect()] == ["han", "latin", "mixed:latin+han", "nonlinguistic", "nonlinguistic"]


def _prep(spark, rows):
    return prepare.start(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t string, w double"), "t", "i", "w")


@pytest.mark.parametrize(("hits", "refused"), [(24, False), (25, False), (26, True)])
def test_large_removal_is_refused(spark, hits, refused):
    report = prepare.Report()
    out = prepare.drop_regex(_prep(spark, [("bad" if i < hits else "good", 1.0) for i in range(100)]), "bad", "gone", report)
    assert ("flag_refused_gone" in out.columns) == refused == bool(report.refusals)
    assert out.count() == 100 and out.where("tier = 'gone'").count() == (0 if refused else hits)


def test_head_cut_keeps_ties_and_refuses_without_weights(spark):
    out = prepare.head_cut(_prep(spark, [("a", 5.0), ("b", 3.0), ("c", 3.0), ("d", 1.0), ("e", 0.5)]), 2)
    assert {r.query for r in out.where("tier = 'user'").collect()} == {"a", "b", "c"}
    with pytest.raises(prepare.Refused):
        prepare.head_cut(_prep(spark, [("a", None), ("b", 1.0), ("c", None)]), 1)


def test_aggregate_keeps_first_values_and_null_weights(spark):
    out = {r.query: r for r in prepare.aggregate_by_query(_prep(spark, [("a", None), ("a", None), ("b", 1.0), ("b", 2.0)])).collect()}
    assert out["a"].pv_raw is None and out["b"].pv_raw == 3.0 and out["a"].n_rows_raw == 2


def test_normalise_fills_with_the_least_weight(spark):
    df = _prep(spark, [("a", 4.0), ("b", 1.0), ("c", None), ("d", -1.0)]).withColumn("snapshot", F.lit("s"))
    got = {r.query: round(r.pv_norm, 3) for r in prepare.normalise(df).collect()}
    assert got == {"a": round(40000 / 7, 3), "b": round(10000 / 7, 3), "c": round(10000 / 7, 3), "d": round(10000 / 7, 3)}


def test_plans(spark):
    assert prepare.validate_plan([{"op": "drop_regex", "pattern": "("}, {"op": "fly"}, {"op": "head_cut", "n": "x"}])
    with pytest.raises(prepare.Refused):
        prepare.run_plan(_prep(spark, [("a", 1.0)]), [{"op": "length_filter", "most": 3}])
    assert prepare.heuristic_plan({"prefix": "hi ", "prefix_share": 0.3})[1]["op"] == "strip_prefix"
    assert prepare.axis_of(["2024-01", "2024-02"]) == "time" and prepare.axis_of(["head", "tail"]) == "stratum"
    assert prepare.wrapper_prefixes([("你好，", 50, 9), ("你好，请", 48, 9), ("abc", 20, 5)]) == [("你好，请", 48), ("abc", 20)]


def test_superset_check(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k long, q string, w double")
    assert prepare.superset_check(a, a, ["k"], ["q", "w"]).count() == 0
    with pytest.raises(prepare.Refused):
        prepare.assert_superset(a, a.where("k = 1"), ["k"], ["q"])


def test_absence_verdicts(spark):
    rows = [("big", "a")] * 400 + [("big", "b")] * 400 + [("gone", "a")] * 40 + [("rare", "a")]
    g = compare.grid(spark.createDataFrame(rows, "c string, s string"), "c", "s", ["a", "b"])
    got = {r.cls: r.verdict for r in compare.absence(g).collect()}
    assert got == {"gone": "true absence", "rare": "undecidable"}


def test_distance_bounds_tell_noise_from_change():
    same, far = compare.distance_bounds([500, 500], [490, 510], "t"), compare.distance_bounds([900, 100], [100, 900], "t")
    assert not same["exceeds_noise"] and far["exceeds_noise"] and far == compare.distance_bounds([900, 100], [100, 900], "t")


def test_partition_scores():
    same = labels.partition_scores([("a", "x", 10), ("b", "y", 10)])
    assert same["ari"] == same["ami"] == same["purity"] == 1.0
    independent = labels.partition_scores([("a", "x", 100), ("a", "y", 100), ("b", "x", 100), ("b", "y", 100)])
    assert abs(independent["ari"]) < 0.01 and abs(independent["ami"]) < 0.01


def test_sign_test_and_codes():
    assert labels.score_verdicts(18, 2, 3)["promoted"] and not labels.score_verdicts(6, 1, 0)["promoted"]
    assert labels.normalise_code("it is U02 here", ["U01", "U02"]) == "U02" and labels.normalise_code("U01 or U02", ["U01", "U02"]) is None
    assert labels.usable_markers(["怎么、如何", "X{n}", "a b"]) == ["怎么", "如何"]
    assert labels.gold_size(100) == 50 and labels.gold_size(100_000) == 3000


def test_mining_helpers():
    assert mine.drop_subsumed([("abc", 10), ("ab", 11), ("zz", 5)]) == [("abc", 10), ("zz", 5)]
    rows = [("怎么算 x", "A")] * 6 + [("翻译 x", "B")] * 6
    marks = mine.discriminating_markers(rows, ("A", "B"))
    assert {c for _, c, _ in marks} == {"A", "B"} and all(n == 6 for _, _, n in marks)


def test_hamilton_and_strata():
    assert sampling.hamilton({"a": 0.5, "b": 0.3, "c": 0.2}, 10, {"a": 2, "b": 9, "c": 9}) == {"a": 2, "b": 5, "c": 3}
    assert sum(sampling.allocate({"a": 90, "b": 9, "c": 1}, 10).values()) == 10
    with pytest.raises(ValueError):
        sampling.allocate({"a": 1, "b": 1}, 1)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "i")
    a, b = (sorted(r.i for r in sampling.subsample(df.repartition(n), 20, "i").collect()) for n in (1, 7))
    assert a == b and len(a) == 20


def test_shape_declares_what_it_leaves_out(spark):
    df = spark.createDataFrame([(i, str(i), None if i % 2 else "x") for i in range(20)], "a int, b string, c string")
    out, said = sampling.shape(df, {"a": ">3", "c": "x"}, ["b"], "b", True, 3)
    assert [r.b for r in out.collect()] == ["18", "16", "14"] and said == {"matched": 8, "shown": 3, "left_out": 5}
    assert sampling.clip({"k": 1, "rows": ["x" * 100] * 50}, 1000)["rows_left_out"] > 0


def test_selection():
    rows = [{"k": 2, "a": 0.5, "b": 3.0}, {"k": 3, "a": 0.9, "b": 2.0}, {"k": 4, "a": 0.89, "b": 2.5}, {"k": 5, "a": 0.4, "b": math.nan}]
    assert [r["k"] for r in select.pareto_front(rows, {"a": True, "b": True})] == [2, 3, 4, 5]
    assert [r["k"] for r in select.tie_set(rows, "a", fallback=0.02)] == [3, 4]
    c = select.select(rows, locator="a", objectives={"a": True, "b": True}, fallback=0.02, reject=lambda r: "low" if r["a"] < 0.45 else "", prefer=lambda r: r["k"])
    assert c.chosen["k"] in (2, 3) and len(c.rejected) == 1
    with pytest.raises(ValueError):
        select.assert_blind({"x": [{"ari_score": 1}]})
    assert select.validate_additions([1.0, 2.05, 99], [2.0], 0, 10, 0.1, 5) == ([1.0], [(2.05, "not new"), (99, "outside the range")])


def test_expressions_and_edits():
    art = {"m": {"x": 3, "rows": [1, 2, 3]}, "t": 0.25}
    assert checks.evaluate("m['x'] == len(m['rows']) and all(r > 0 for r in m['rows'])", art)
    for bad in ("__import__('os')", "m.x", "(lambda: 1)()", "[a for a in m['rows'] for b in m['rows']]"):
        with pytest.raises((checks.Refused, SyntaxError)):
            checks.evaluate(bad, art)
    assert checks.check_numbers("25% of 300", [0.25, 300]) == [] and checks.check_numbers("26%", [0.25]) == ["26%"]
    edit = {"file": "r", "anchor": "was 20%", "replacement": "was 25%", "artifact": "t", "reason": "r"}
    out, refused = checks.apply_edits([edit, edit], {"r": "it was 20% once"}, art)
    assert out["r"] == "it was 25% once" and refused[0][1] == "the anchor does not occur exactly once"


def test_ledger_reopens():
    led = checks.Ledger()
    led.record("12 rows lost!", "p1", "high", "n > 0")
    led.recheck({"n": 0})
    assert led.findings[checks.fingerprint("rows lost")]["status"] == "fixed"
    assert led.record("13 rows lost", "p2", "high")["status"] == "open" and len(led.findings) == 1
    with pytest.raises(checks.Refused):
        checks.gate("g", False, 1, 2, ("g",))


def test_governance():
    fam = {0: 0, 1: 0, 2: 1, 3: 2}
    assert cluster.apply_merges(fam, {2: 1, 1: 0}) == {0: 0, 1: 0, 2: 0, 3: 0}
    ps = [{"id": "a", "kind": "isolate_leaf", "targets": [1]}, {"id": "b", "kind": "merge_leaves", "targets": [0, 1]}, {"id": "c", "kind": "fly", "targets": []}]
    out, ledger = cluster.execute_prescriptions(fam, ps)
    assert out[1] not in (out[0], out[2], out[3]) and {x["id"]: x["status"] for x in ledger} == {"a": "executed", "b": "declined", "c": "declined"}
    cluster.assert_settled(ps, ledger)
    assert math.isnan(cluster.noise_floor([1, 2, 3]))
    assert cluster.triangulate([{"k": k, "stability": s, "ami": a} for k, s, a in [(2, 0.9, 0.5), (3, 0.8, 0.7), (4, 0.8, 0.705), (5, 0.1, 0.9)]])["k"] == 3


def test_vectors_on_blobs(spark):
    rows = [(i, [1.0 + 0.01 * (i % 7), 0.02 * (i % 5)] if i % 2 else [0.02 * (i % 3), 1.0], i % 2) for i in range(60)] + [(100, None, 1), (101, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "i long, v array<double>, l int")
    cents = vectors.centroids(df, "l", "v")
    a = vectors.assign(df, "v", cents, ["i", "l"]).collect()
    assert len(a) == 60 and all(r.assigned == r.l for r in a)
    assert vectors.silhouette(df, "l", "v", ["i"]).agg(F.min("silhouette")).head()[0] > 0.9
    k = cluster.kmeans(df.where("i < 60"), "v", 2)
    assert labels.score_partition(k, "l", "cluster").head().ari == 1.0
    assert vectors.assign(df.limit(0), "v", cents, ["i"]).count() == 0


def test_wrapped_takes_the_longest_head(spark):
    texts = spark.createDataFrame([(1, "please find Lorpemire reader now"), (2, "xyz"), (3, "reader")], "i long, t string")
    heads = spark.createDataFrame([("reader",), ("Lorpemire reader",), ("12345",), (None,)], "h string")
    assert [(r.i, r.head) for r in relate.wrapped(texts, heads, "t", "h", ["i"]).collect()] == [(1, "Lorpemire reader")]


def test_readers_and_store(spark, tmp_path):
    df = spark.createDataFrame([("a", "20240101", 1), ("b", "20240101", 2)], "query string, dt string, w int")
    p = str(tmp_path / "x.parquet")
    df.write.parquet(p)
    assert readers.snapshot_tag(readers.read_any(spark, p), p) == "20240101"
    with pytest.raises(prepare.Refused):
        readers.read_any(spark, "x.xlsx")
    with pytest.raises(prepare.Refused):
        readers.pool([("t", df), ("t", df)])
    assert readers.build_frame(df, "query", "w").orderBy("row_id").select("row_id").collect()[1].row_id == 1
    with pytest.raises(prepare.Refused):
        readers.verified_join(df.select("w", "query"), df.withColumn("query", F.lit("z")).select("w", "query"), "w", "query")
    st = store.ArtifactStore(str(tmp_path / "run"))
    st.put_table("t", df)
    with pytest.raises(prepare.Refused):
        st.put_table("t", df)
    st.new_generation("again")
    assert st.table(spark, "t").count() == 2 and store.hash_table(df) == store.hash_table(df.repartition(3))
    calls = []
    for _ in range(2):
        st.memoize(spark, "op", {"a": 1}, "h", lambda: calls.append(1) or df)
    assert len(calls) == 1


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    ev.repartitionByRange(4, "ts").write.parquet(src)
    stream = movement.event_stream(spark, src, ev.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    q = movement.write(movement.class_counts(stream, "ts", "event_type", late="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert not q.isActive
    batch = movement.class_counts(ev, "ts", "event_type")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(batch).count() == 0


def test_entry_and_registry(spark):
    assert queries.flagship(spark, SMALL).count() > 0
    assert set(queries.oracle_sql()) <= set(queries.queries())


PARITY = ["class_matrix", "pairwise_change_newcombe", "class_absence", "prep_pv_norm", "prep_headcut_ties", "affix_mining_part", "distinctive_ngrams", "log_odds_words", "annotator_kappa_gold", "rule_conflicts", "cosine_silhouette", "containment_wrap_join", "canonical_frame"]


@pytest.mark.parametrize("name", PARITY)
def test_sql_parity(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    a = queries.queries()[name](spark, SMALL)
    cols = sorted(a.columns)
    cell = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    mine_ = sorted(str([cell(r[c]) for c in cols]) for r in a.collect())
    rel = con.sql(queries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(str([cell(r[i]) for i in at]) for r in rel.fetchall())
    assert mine_ == theirs


def test_discriminating_markers_read_every_gold_row(spark, tmp_path):
    """The marker of a pair stands only in the last of 20,600 agreed rows; the result equals the driver's greedy cover."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    rows = [(i, word() + ("qz" if i >= 20_500 and i % 2 else ""), "U01", "U01", "U01" if i % 2 else "U02", True) for i in range(20_600)]
    rows += [(30_000, "x", "U01", "U02", "U01", False), (30_001, "y", "U03", "U02", "U03", False), (30_002, None, "U01", "U02", "U01", True)]
    spark.createDataFrame(rows, "idx long, query string, label_a string, label_b string, final_label string, agreed boolean").coalesce(1).write.parquet(f"{tmp_path}/gold_rows.parquet")
    got = [tuple(r) for r in queries.queries()["discriminating_markers"](spark, str(tmp_path)).collect()]
    agreed = [(r[1], r[4]) for r in rows if r[5] and r[1]]
    want = []
    for p in (("U01", "U02"), ("U02", "U03")):
        marks = mine.discriminating_markers(agreed, p)
        default = mine.boundary_default(agreed, p, [m for m, _, _ in marks])
        want += [(*p, *m, default) for m in marks]
    assert got == want and ("U01", "U02", "qz", "U01", 50) in {r[:5] for r in got}


def test_wrapped_takes_heads_of_any_length(spark):
    long_head = "how to read the very long title of a chemistry kit"
    t = spark.createDataFrame([(1, f"please tell me {long_head}"), (2, "the kit now")], "i long, t string")
    h = spark.createDataFrame([(long_head,), ("chemistry kit",), ("kit",), ("123",)], "h string")
    assert {(r.i, r.head) for r in relate.wrapped(t, h, "t", "h", ["i"]).collect()} == {(1, long_head), (2, "kit")}


def test_model_queries_run_with_the_settings_of_the_operators(spark, monkeypatch):
    from lodeline.operators import model

    seen = {}
    monkeypatch.setattr(model, "cross_validated", lambda *a, **k: (seen.setdefault("grid", k), 0.0))
    monkeypatch.setattr(model, "bootstrap_share", lambda *a, **k: seen.setdefault("draws", k))
    monkeypatch.setattr(cluster, "algorithm_battery", lambda df, vec, unique, ks: [{"algorithm": "kmeans", "k": k, "stability": 1.0} for k in ks])
    q = queries.queries()
    q["classifier_out_of_fold"](spark, SMALL)
    q["bootstrap_weight_share"](spark, SMALL)
    assert "grid" not in seen["grid"] and "draws" not in seen["draws"]
    assert {r.k for r in q["algorithm_battery"](spark, SMALL).collect()} == {15, 20, 30}


def test_running_sums_span_partitions_and_groups(spark):
    """One value holds a third of all rows; sums before equal those of a plain loop, and so does the Gini coefficient."""
    from lodeline.session import running_before

    rows = [(i % 5, 0 if i % 3 == 0 else i % 97, 1 + i % 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, x int, c long").groupBy("g", "x").agg(F.sum("c").alias("c"))
    run = 0
    for r in sorted(running_before(df, ["g", "x"], "c", "before").collect()):
        assert r.before == run
        run += r.c
    weights = [float(x) for g, x, _ in rows if g == 2 and x > 0]
    n, got = len(weights), {r.grp: r for r in compare.gini(spark.createDataFrame(rows, "g int, x int, c long"), "g", F.when(F.col("x") > 0, F.col("x").cast("double"))).collect()}
    want = 2 * sum((i + 1) * w for i, w in enumerate(sorted(weights))) / (n * sum(weights)) - (n + 1) / n
    assert abs(got[2].gini - want) < 1e-9


def test_duplicates_of_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 1500}" if i % 50 else None, "user") for i in range(6000)]
    df = spark.createDataFrame(rows, "row_ord long, query string, tier string").repartition(6)
    out = {r.row_ord: r.tier for r in prepare.drop_duplicates(df).collect()}
    seen = set()
    for i, q, _ in rows:
        assert out[i] == ("drop_duplicates" if q is not None and q in seen else "user")
        seen.add(q)


def test_expected_information_is_exact_at_any_size():
    """Equal to the plain sum over all counts, above and below the size at which it used to be left out."""
    import math

    from lodeline.operators.labels import _expected_mi

    def plain(ra, rb, n):
        lg, total = math.lgamma, 0.0
        for a in ra:
            for b in rb:
                for x in range(max(1, a + b - n), min(a, b) + 1):
                    p = lg(a + 1) + lg(b + 1) + lg(n - a + 1) + lg(n - b + 1) - lg(n + 1) - lg(x + 1) - lg(a - x + 1) - lg(b - x + 1) - lg(n - a - b + x + 1)
                    total += math.exp(p) * x / n * math.log(n * x / (a * b))
        return total

    for ra, rb in (([3, 5, 8], [6, 10]), ([500, 300, 200], [10, 990]), ([1] * 7, [2, 5])):
        assert abs(_expected_mi(ra, rb, sum(ra)) - plain(ra, rb, sum(ra))) < 1e-9
    assert 0 <= _expected_mi([10**9, 2 * 10**9], [10**9, 2 * 10**9], 3 * 10**9) < 1e-8
    assert _expected_mi([2] * 600, [2] * 600, 1200) > 1


def test_bootstrap_keeps_the_strata(spark):
    """Two strata of very different weight, each all or nothing: no draw can move the share."""
    df = spark.createDataFrame([(i, "a" if i < 50 else "b", 10.0 if i < 50 else 1.0) for i in range(500)], "id long, s string, w double")
    from lodeline.operators import model

    r = model.bootstrap_share(df, "s", F.col("s") == "a", F.col("w"), draws=50).head()
    assert abs(r.share - 500 / 950) < 1e-9 and abs(r.lo - r.share) < 1e-9 and abs(r.hi - r.share) < 1e-9
    r = model.bootstrap_share(df, "s", F.col("id") % 2 == 0, F.col("w"), draws=200).head()
    assert r.lo < r.share < r.hi and r.hi - r.lo < 0.3


@pytest.mark.parametrize("hot", [20_000, 0])
def test_tfidf_keeps_grams_in_their_row(spark, monkeypatch, hot):
    """No table or shuffle of ids and grams; texts of one id add up, and rows without an id count once a term."""
    from lodeline.operators import model

    monkeypatch.setattr(model, "HOT_KEYS", hot, raising=False)
    rows = [(1, "Abab"), (1, "ab"), (2, "b𝒳b"), (3, ""), (4, None), (None, "ab"), (None, "ab"), (5, "a" * 300), (6, "q")]
    got = model.tfidf(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    tf, lost = {}, set()
    for i, t in rows:
        for g in [t.lower()[j : j + k] for k in (1, 2, 3) for j in range(len(t) - k + 1)] if t else []:
            if i is None:
                lost.add(g)
            else:
                tf[i, g] = tf.get((i, g), 0) + 1
    df = {g: sum(h == g for _, h in tf) + (g in lost) for _, g in tf}
    w = {(i, g): (1 + math.log(n)) * (math.log(9 / (1 + df[g])) + 1) for (i, g), n in tf.items() if df[g] >= 2}
    want = {(i, g): x / math.sqrt(sum(y * y for (j, _), y in w.items() if j == i)) for (i, g), x in w.items()}
    assert {(r.id, r.term): pytest.approx(r.weight) for r in got.collect()} == want and len(want) == 5
    assert not re.search(r"keys=\[id#\d+L?, term#", got._jdf.queryExecution().executedPlan().toString())
