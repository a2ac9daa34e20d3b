"""Top rows, consensus, neighbours, copies, clusters and mixing against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import clusters, consensus, copies, mixing, neighbours, topn


def test_top_n_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), float(rng.randrange(5)), rng.choice([None, 1, 2]), i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, pv double, rank int, row_id long, place string")
    order = [F.col("pv").desc(), F.col("rank").asc_nulls_last(), F.col("row_id").asc()]
    got = {(r.g, r.row_id, r.place) for r in topn.top_n(df, ["g"], order, 3, ["row_id", "pv", "rank"]).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        s = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[3]))
        want |= {(g, r[3], i + 1) for i, r in enumerate(s[:3])}
    assert got == want
    assert topn.top_n(df.limit(0), ["g"], order, 3, ["row_id", "pv", "rank"]).count() == 0


def test_first_delivery(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0), ("b", 3, 2.0)], "k string, row_id long, v double")
    assert {(r.k, r.row_id) for r in topn.first_delivery(df, "k", "row_id", ["v"]).collect()} == {("a", 1), ("b", 3)}


def test_first_delivery_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0), (None, 3, 2.0), (None, 4, 3.0)], "k string, row_id long, v double")
    assert {(r.k, r.row_id, r.v) for r in topn.first_delivery(df, "k", "row_id", ["v"]).collect()} == {("a", 1, 1.0), (None, 3, 2.0), (None, 4, 3.0)}


def test_consensus_recovers_truth_and_competence(spark):
    rng = random.Random(5)
    votes, vid = [], 0
    quality = {"good": 0.95, "fair": 0.8, "ok": 0.75, "spam": 0.0}
    truth = {i: rng.randrange(1, 14) for i in range(400)}
    for i, t in truth.items():
        for a, q in quality.items():
            c = t if rng.random() < q else 7
            votes.append((vid, i, a, f"U{c:02d}"))
            vid += 1
    votes += [(vid, 0, "good", "nonsense"), (vid + 1, None, "good", "U01"), (vid + 2, 999, "good", None), (vid + 3, 1, None, "U02")]
    v = spark.createDataFrame([(*x, 1) for x in votes], "vote_id long, row_id long, annotator string, u_code string, voted_at int")
    main = spark.createDataFrame([(i, None, "u9", None) for i in list(truth)[:5]], "row_id long, u_ds string, u_qw string, own_code string")
    walk = spark.createDataFrame([("E01", "U01")], "own_code string, u_code string")
    got = {r.row_id: r for r in consensus.found(v, main, walk).collect()}
    assert set(got) == {*truth, 999} and got[999].u_code is None
    assert sum(got[i].u_code == f"U{t:02d}" for i, t in truth.items()) >= 0.93 * len(truth)
    _, m = consensus.solve(v, main, walk)
    by = dict(zip(m.annotators, m.competence))
    assert by["good"] > by["ok"] > by["spam"] and m.guesses[m.annotators.index("spam")].argmax() == 6
    assert consensus.found(v.limit(0), main, walk).count() == 0


def test_consensus_covers_rows_without_votes(spark):
    v = spark.createDataFrame([(1, 1, "a", "U01", 1)], "vote_id long, row_id long, annotator string, u_code string, voted_at int")
    main = spark.createDataFrame([(1, "u1", None, None), (2, "U02", "u2", "E03"), (3, None, "zz", None), (4, None, None, "e03")], "row_id long, u_ds string, u_qw string, own_code string")
    walk = spark.createDataFrame([("E03", "U03")], "own_code string, u_code string")
    got = {r.row_id: r for r in consensus.judge(v, main, walk).collect()}
    assert set(got) == {1, 2, 3, 4} and [got[i].n_labels for i in (1, 2, 3, 4)] == [2, 3, 0, 1]
    assert got[2].u_code and abs(got[2].agreement - 1 / 3) < 1e-9 and got[3].u_code is None and got[4].u_code
    assert {r.row_id for r in consensus.found(v, main, walk).collect()} == {1}
    _, m = consensus.solve(v, main, walk)
    assert dict(zip(m.annotators, m.n_labels)) == {"a": 1, "labeller:own_code": 2, "labeller:u_ds": 2, "labeller:u_qw": 1}


def test_latest_vote_counts(spark):
    v = spark.createDataFrame([(1, 5, "a", 0, 10), (2, 5, "a", 1, 20), (3, 5, "a", 2, 20)], "vote_id long, row_id long, annotator string, code int, at int")
    assert [r.code for r in consensus.latest(v, "row_id", "annotator", "code", "at", "vote_id").collect()] == [2]


@pytest.mark.parametrize(("text", "code"), [("U01", 0), (" u1 ", 0), ("U13", 12), ("U14", None), ("n/a", None), ("", None), (None, None)])
def test_read_code(spark, text, code):
    df = spark.createDataFrame([(text,)], "c string").select(consensus.read_code(F.col("c")).alias("k"))
    assert df.head().k == code


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 1500)] + 0.45 * rng.normal(size=(1500, 64))
    x *= rng.uniform(0.3, 9, (1500, 1))
    x[7] = x[3]
    x[8] = x[3]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 64), (2002, [1.0] * 63), (2003, [float("nan")] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<float>")
    got = {(r.vec_id, r.place, r.nn_vec_id) for r in neighbours.similar(df, "vec_id", "vec", 64, 5, 0.8).collect()}
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = np.round(y @ y.T, 6)
    np.fill_diagonal(s, -1)
    want = set()
    for i in range(len(y)):
        c = np.flatnonzero(s[i] >= 0.8)
        want |= {(i, p + 1, int(j)) for p, j in enumerate(c[np.lexsort((c, -s[i][c]))][:5])}
    pairs = {(a, c) for a, _, c in want}
    assert len(pairs & {(a, c) for a, _, c in got}) >= 0.97 * len(pairs)
    assert {g for g in got if g[0] == 3 and g[1] <= 2} == {(3, 1, 7), (3, 2, 8)}
    assert all(a < 2000 and c < 2000 for a, _, c in got)
    assert neighbours.similar(df.limit(0), "vec_id", "vec", 64, 5, 0.8).count() == 0


def test_neighbours_of_one_direction_are_ranked_by_id(spark):
    """Forty lengths of one direction tie at 1 after rounding; the smallest ids win, whatever float noise says."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=64) * rng.uniform(0.3, 9, (40, 1))
    x = np.concatenate([x, rng.normal(size=64) * 2.0 ** rng.integers(-3, 4, (20, 1))])
    df = spark.createDataFrame([(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)], "vec_id long, vec array<float>")
    got = {}
    for r in neighbours.similar(df, "vec_id", "vec", 64, 5, 0.8).collect():
        got.setdefault(r.vec_id, []).append((r.place, r.nn_vec_id))
    for i in range(60):
        own = range(40) if i < 40 else range(40, 60)
        assert [b for _, b in sorted(got[i])] == [j for j in own if j != i][:5]


def test_a_direction_shared_by_a_third_of_all_vectors(spark):
    """More vectors of one direction than stand for themselves: the rest follow and get the smallest ids."""
    rng = np.random.default_rng(8)
    n, hot = 6000, 2000
    one = rng.normal(size=64)
    x = np.where((np.arange(n) % 3 == 0)[:, None], one * 2.0 ** rng.integers(-3, 4, (n, 1)), rng.normal(size=(n, 64)))
    df = spark.createDataFrame([(int(i), [float(np.float32(v)) for v in r]) for i, r in enumerate(x)], "vec_id long, vec array<float>").repartition(5)
    got = {}
    for r in neighbours.similar(df, "vec_id", "vec", 64, 5, 0.8).collect():
        got.setdefault(r.vec_id, []).append((r.place, r.nn_vec_id))
    ids = list(range(0, n, 3))
    assert len(ids) == hot > neighbours.SALTS * 8
    for i in ids:
        assert [b for _, b in sorted(got[i])] == [j for j in ids[:6] if j != i][:5] and [p for p, _ in sorted(got[i])] == [1, 2, 3, 4, 5]


def test_collisions_are_counted_by_grid():
    """A pair in two lists of one grid counts once, windows cut far values, and a list may span batches."""
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.float32()), pa.array([r[2] for r in rows])], names=neighbours._ENTRY.names)
    entries = [(3, 0.0, 1), (3, 0.1, 2), (5, 0.0, 1), (5, 0.1, 2), (13, 0.0, 2), (13, 0.3, 1), (13, 0.9, 4), (17, 0.0, 5), (17, 0.1, 6), (25, 0.0, 6), (25, 0.05, 5)]
    for cut in (3, 6, 11):
        packs = list(neighbours._collide([0.2, 0.5], 10, 1)(iter([batch(entries[:cut]), batch(entries[cut:])])))
        got = {(r["a"], r["b"], r["level"]) for b in neighbours._count(iter(packs)) for r in b.to_pylist()}
        assert got == {(1, 2, 1), (5, 6, 0)}


def test_copies(spark):
    q = ["Hello, World", "hello world!", "HELLO​ WORLD", "hello word", "a: 1; b: 2", "B:2\na : 1;", "a: 2; b: 1", None, "...", "ich heiße", "ICH HEISSE", "1+1", "11"]
    rows = [(i, "r", 5.0, t) for i, t in enumerate(q)] + [(50, "s", 5.0, "hello world"), (51, "r", None, "hello world"), (52, "r", float("nan"), "hello world"), (53, "r", 5.0, "x" * 50_000), (54, "r", 5.0, "X" * 50_000)]
    rows += [(100 + i, "r", -1.0, "hot") for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, own_run string, pv double, query string")
    got = {(r.first_row_id, r.row_id) for r in copies.find_copies(df, "row_id", ["own_run", "pv"], "query").collect()}
    assert got == {(0, 1), (0, 2), (4, 5), (9, 10), (53, 54)} | {(100, 100 + i) for i in range(1, 500)}
    n = {r.first_row_id: r.n_copies for r in copies.collapse(df, "row_id", ["own_run", "pv"], "query").collect()}
    assert n[100] == 500 and n[0] == 3 and n[3] == 1 and sum(n.values()) == len(rows) - 4
    assert copies.find_copies(df.limit(0), "row_id", ["own_run", "pv"], "query").count() == 0


def test_runs_over_partition_borders_meet():
    """The scan of two partitions of one run leaves lines from which the run is put together."""
    import pyarrow as pa

    batch = lambda k, i, p: pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(i, pa.int64()), pa.array([p] * len(i), pa.int32())], names=["key", "row_id", "part"])
    scan = lambda *b: [r for x in copies._scan(iter(b)) for r in x.to_pylist()]
    one = scan(batch([b"a", b"b"], [1, 2], 0), batch([b"b"], [3], 0))
    assert [(r["kind"], r["first_row_id"], r["row_id"]) for r in one] == [(copies.FIRST, 1, 1), (copies.COPY, 2, 3), (copies.BORDER, 1, None)]
    assert (one[-1]["last_key"], one[-1]["last_run"], one[-1]["n"], one[-1]["first_n"], one[-1]["last_n"]) == (b"b", 2, 2, 1, 2)
    two = scan(batch([b"b", b"b", b"c", b"d", b"d"], [4, 5, 6, 7, 8], 1), batch([b"d", b"e"], [9, 10], 1))
    assert {(r["first_row_id"], r["n"]) for r in two if r["kind"] == copies.RUN} == {(6, 1), (7, 3)}
    assert (two[-1]["first_n"], two[-1]["last_run"], two[-1]["last_n"], two[-1]["n"]) == (2, 10, 1, 4)
    assert scan(batch([b"z"], [1], 2), batch([b"z"], [2], 2))[-1]["first_n"] == 2
    assert len(scan(batch([b"z" * 9999], [1], 3))[-1]["last_key"]) < 64


def test_copies_over_many_partitions(spark):
    """One record with a third of all rows, cut over partitions: copies and exact counts equal a plain grouping."""
    rows = [(i, "r", 1.0, "hot record" if i % 3 == 0 else f"record {i % 700}") for i in range(6000)]
    df = spark.createDataFrame(rows, "row_id long, own_run string, pv double, query string")
    by = {}
    for i, _, _, q in rows:
        by.setdefault(q, []).append(i)
    got = {(r.first_row_id, r.row_id) for r in copies.find_copies(df, "row_id", ["own_run", "pv"], "query").collect()}
    assert got == {(v[0], x) for v in by.values() for x in v[1:]}
    assert {r.first_row_id: r.n_copies for r in copies.collapse(df, "row_id", ["own_run", "pv"], "query").collect()} == {v[0]: len(v) for v in by.values()}


LEAVES = {"mock": ["{} mock test", "take a {} mock test", "full mock test of the {}"], "pdf": ["{} pdf download", "download the {} as pdf", "free pdf of the {}"]}


def test_clusters_of_requests(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(1200):
        name, leaf = rng.choice(["Lorpemire", "zanfalor", "Brimowick", "selfador"]), rng.choice(list(LEAVES))
        noun = rng.choice(["reader", "chemistry kit"])
        text = rng.choice(LEAVES[leaf]).format(f"{name} {noun}") + rng.choice(["", "?", " please", " grade 3"])
        rows.append((i, "r", text, f"{name} {noun}" if rng.random() < 0.8 else None, leaf if rng.random() < 0.7 else rng.choice([None, "pdf"])))
        truth[i] = (leaf, name.lower(), noun)
    rows += [(5000, "r", None, None, None), (5001, "r", "ok", None, None), (5002, "r", "", None, None), (5003, "r", "title: abc; grade: 3", None, None), (5004, "r", "grade: 4; title: abc", None, None)]
    df = spark.createDataFrame(rows, "row_id long, own_run string, query string, core string, own_leaf string")
    first = {r.row_id: r.first_row_id for r in clusters.find_members(df, "row_id", "own_run", "query", "core", "own_leaf").collect()}
    groups = Counter((truth[first.get(i, i)], t) for i, t in truth.items())
    assert all(a == b for a, b in groups), groups
    assert len({first.get(i, i) for i in truth}) == len(set(truth.values()))
    assert first[5004] == 5003 and not {5000, 5001, 5002} & set(first)
    d = clusters.describe(df, "row_id", "own_run", "query", "core", "own_leaf").collect()
    assert sum(r.n_rows for r in d) == 1202 and all(1 <= len(r.typical) <= 3 for r in d)


def _vectors(vectors: dict[bytes, int], size: int = 1000) -> list:
    import pyarrow as pa

    rows = [("r", "x", v) for v, n in vectors.items() for _ in range(n)]
    random.Random(0).shuffle(rows)
    return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), (pa.string(), pa.string(), pa.binary()))], names=["scope", "object", "vector"]) for i in range(0, len(rows), size)]


def _by_cell(batches: list) -> list:
    import pyarrow as pa

    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["scope"], r["object"], r["cell"]))
    return [pa.RecordBatch.from_pylist(rows, schema=batches[0].schema)]


def _centres(vectors: dict[bytes, int]) -> np.ndarray:
    merged = _by_cell(list(clusters._merge(iter(_by_cell(list(clusters._summarise(iter(_vectors(vectors)))))))))
    (got,) = [r for b in clusters._agglomerate(iter(merged)) for r in b.to_pylist()]
    assert got["n"] == sum(vectors.values())
    return np.frombuffer(got["centres"], np.float32).reshape(-1, len(next(iter(vectors))))


def test_rare_requests_about_a_hot_object_stay_apart():
    """1,000 rows of one request and 5 of another, through both rounds of summaries; and more requests than LEAVES."""
    hot = lambda i, wide: bytes(255 if j == i else 0 for j in range(wide))
    assert len(_centres({hot(0, 3): 1000, hot(1, 3): 5})) == 2
    assert len(_centres({hot(0, 3): 100, hot(1, 3): 8})) == 2 and len(_centres({hot(0, 3): 5, hot(1, 3): 1})) == 2
    assert len(_centres({hot(i, 300): 1000 if i == 7 else 5 for i in range(300)})) == 300


def test_features_do_not_depend_on_partitions():
    """Summaries sent early and from several partitions merge to exactly those of one pass."""
    rng = np.random.default_rng(5)
    vectors = {bytes(rng.integers(0, 256, 5).astype(np.uint8)): int(rng.integers(1, 4)) for _ in range(400)}
    batches = _vectors(vectors, 100)
    whole = [b.to_pylist() for b in clusters._merge(iter(_by_cell(list(clusters._summarise(iter(batches))))))]
    for parts in (3, 8):
        summaries = [x for k in range(parts) for x in clusters._summarise(iter(batches[k::parts][::-1]))]
        assert [b.to_pylist() for b in clusters._merge(iter(_by_cell(summaries)))] == whole


def test_clusters_do_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/sva_dom_edu_wraps_head.parquet")
    find = lambda x: sorted(map(tuple, clusters.find_members(x, "row_id", "own_run", "query", "core", "own_leaf").collect()))
    one = find(df)
    assert len(one) > 100 and find(df.repartition(7)) == one and find(df.orderBy(F.desc("row_id"))) == one


def test_objects_of_a_kind_never_seen_are_grouped(spark):
    """60 rows about one object, and pairs of names, whose kind and names occur nowhere else."""
    df = spark.read.parquet("/root/testdata/sf0.001/sva_dom_edu_wraps_head.parquet").select("row_id", "own_run", "query", "core", "own_leaf")
    rows = [(90000 + i, "r", "open the zorbl symposium website" + ["", "?", " please"][i % 3], "zorbl symposium" if i % 2 else None, None) for i in range(60)]
    rows += [(91000, "r", "compare quabim with zendoro", None, None), (91001, "r", "please compare zendoro with quabim!", None, None), (91002, "r", "quabim to zendoro conversion", None, None), (91003, "r", "zendoro to quabim conversion", None, None)]
    got = clusters.find_members(df.unionByName(spark.createDataFrame(rows, df.schema)), "row_id", "own_run", "query", "core", "own_leaf").where("row_id >= 90000")
    assert {(r.first_row_id, r.row_id) for r in got.collect()} == {(90000, 90000 + i) for i in range(1, 60)} | {(91000, 91001)}


def test_every_query_that_names_something_is_read(spark):
    """No label or head noun leads to these objects: another script, frequent names, a bare name, a name with a digit; fragments stay out."""
    df = spark.read.parquet("/root/testdata/sf0.01/sva_dom_edu_wraps_head.parquet").select("row_id", "own_run", "query", "core", "own_leaf")
    same = [["请打开佐布研讨会的官网", "请打开佐布研讨会的官网！"], ["open the zorbl symposium website" + x for x in ["", "?", " please"] * 20], ["quabimium", "Quabimium?"], ["download zendoro7 answers", "download zendoro7 answers?"]]
    rows, want = [], set()
    for k, texts in enumerate(same):
        first = 900_000 + 100 * k
        rows += [(first + i, "r", t, None, "official pages") for i, t in enumerate(texts)]
        want |= {(first, first + i) for i in range(1, len(texts))}
    rows += [(990_000 + i, "r", t, None, None) for i, t in enumerate(["继续", "第三单元", "abc", "ok", "page 9", "more", "7", "..."] * 2)]
    got = clusters.find_members(df.unionByName(spark.createDataFrame(rows, df.schema)), "row_id", "own_run", "query", "core", "own_leaf").where("row_id >= 900000")
    assert {(r.first_row_id, r.row_id) for r in got.collect()} == want


def test_a_table_without_labels_is_read(spark):
    rows = [(i, "r", ["download the {} reader", "where can i buy the {} reader"][i % 2].format(f"zorb{'abcdefghij'[i // 2 % 10]}lin"), None, None) for i in range(200)] + [(900, "r", "ok", None, None), (901, "r", "ok", None, None)]
    df = spark.createDataFrame(rows, "row_id long, own_run string, query string, core string, own_leaf string")
    got = {r.row_id: r.first_row_id for r in clusters.find_members(df, "row_id", "own_run", "query", "core", "own_leaf").collect()}
    assert got == {i: i % 20 for i in range(20, 200)}


def test_ward_merges_by_cost_and_never_across_the_cut():
    x = [[1000, np.array([0.0, 0.0]) * 1000, 0.0], [1000, np.array([0.6, 0.0]) * 1000, 0.0], [1, np.array([0.0, 2.0]), 0.0], [1, np.array([0.1, 2.0]), 0.0]]
    assert sorted(map(sorted, clusters.ward(x))) == [[0, 1], [2, 3]]
    assert sorted(map(sorted, clusters.ward(x, 0.2))) == [[0], [1], [2, 3]]
    assert clusters.ward([]) == [] and clusters.ward(x[:1]) == [[0]]


def test_tree_features_add_up():
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(4), 50, 0) + 0.01 * rng.normal(size=(200, 4))
    tree = clusters.Tree()
    for v in x:
        tree.add(1, v, float(v @ v))
    assert sum(n for n, _, _ in tree.leaves) == 200
    assert np.allclose(sum(ls for _, ls, _ in tree.leaves), x.sum(0))
    assert len(clusters.ward(tree.leaves)) == 4


def test_water_filling():
    s = mixing.fill([mixing.Source("a", 0.5, 2, 100), mixing.Source("b", 0.5, 1, 1000), mixing.Source("none", 0.1, 3, 0)], 1000.0)
    assert [round(x.amount) for x in s] == [200, 800, 0]
    s = mixing.fill([mixing.Source("a", 0.5, 2, 100), mixing.Source("b", 0.5, 1, 1000)])
    assert [round(x.amount) for x in s] == [200, 200] and (s[0].whole, s[1].whole) == (2, 0)
    # two sources are clamped one after the other: what the first leaves lifts the second above its cap
    s = mixing.fill([mixing.Source("a", 0.4, 1, 100), mixing.Source("b", 0.3, 1, 320), mixing.Source("c", 0.3, 2, 1000)], 1000.0)
    assert [round(x.amount) for x in s] == [100, 320, 580]


def test_mix_of_all_tokens_is_registered_and_clamped(spark):
    from lodeline.llm import queries

    q, d = queries.queries(), "/root/testdata/sf0.001"
    rows = q["p9_mix"](spark, d).collect()
    report = q["p9_shares"](spark, d).collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += r.n_tokens * r.copies
    assert all(taken[r.source] == r.taken_tokens for r in report)
    live = [r for r in report if r.tokens and r.target_share]
    assert any(r.epochs == r.max_repeats for r in live)


def test_mix_reaches_the_targets_and_caps(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["big"] * 8 + ["small", None, "other"]), rng.randrange(0, 400)) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("empty", 0.1, 3)], "source string, target_share double, max_repeats int")
    got, report = mixing.mix(df, "source", "n_tokens", "doc_id", targets, None)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].actual_share - 2 / 3) < 0.005 and abs(r["small"].actual_share - 1 / 3) < 0.005 and r["empty"].actual_share == 0
    rows = got.collect()
    cap = {"big": 1, "small": 4}
    assert all(1 <= x.copies <= cap[x.source] for x in rows) and len(rows) == len({x.doc_id for x in rows})
    again, _ = mixing.mix(df.repartition(3), "source", "n_tokens", "doc_id", targets, None)
    assert {(x.doc_id, x.copies) for x in again.collect()} == {(x.doc_id, x.copies) for x in rows}
    none, report = mixing.mix(df.limit(0), "source", "n_tokens", "doc_id", targets)
    assert none.count() == 0 and all(x.actual_share == 0 for x in report.collect())
