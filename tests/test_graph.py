import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import analytics as A
from corpusgraph.operators import graph as G
from corpusgraph.operators import pairs as P
from corpusgraph.operators import scorers as S
from corpusgraph.operators import tuning as T
from corpusgraph.plans.components import connected_components

EDGES = [(0, 1, 0.5), (1, 2, 0.25), (0, 2, 1.0), (2, 3, 0.5)]  # a triangle, a pendant node, and node 4 alone


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(i, i % 2, "ab"[i > 2]) for i in range(5)], "id long, num int, label string")
    return nodes, spark.createDataFrame(EDGES, "src long, dst long, weight double")


def test_statistics(small):
    nodes, edges = small
    assert tuple(A.quick_stats(nodes, edges).first()) == (5, 4, 1.6, 0.4)
    assert {r.node: round(r.clustering, 4) for r in A.clustering(nodes, edges, "id").collect()} == {0: 1, 1: 1, 2: 0.3333, 3: 0, 4: 0}
    assert {r.node: r.component for r in A.components(nodes, edges, "id").collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert not A.is_connected(nodes, edges, "id").first()[0]
    assert tuple(A.path_stats(nodes, edges, "id").first()) == (None, None)
    assert tuple(A.path_stats(nodes.where("id < 4"), edges, "id").first()) == (1.333333, 2)
    m = 2.25
    want = (1.75 / m - (4 / (2 * m)) ** 2) + (0 - (0.5 / (2 * m)) ** 2)
    assert A.modularity(edges, nodes, "id", "label").first()[0] == pytest.approx(want, abs=1e-6)
    assert A.connectivity(nodes.where("id < 4"), edges, "id") == {"avg_node_connectivity": 1.5, "node_connectivity": 1, "edge_connectivity": 1}
    empty = A.quick_stats(nodes.limit(0), edges.limit(0)).first()
    assert tuple(empty) == (0, 0, None, None)


def test_evaluation_has_all_blocks(small):
    nodes, edges = (d.cache() for d in (small[0].where("id < 4"), small[1]))
    got = A.evaluate_graph(nodes, edges, "id", "num").first().asDict()
    assert (got["avg_shortest_path"], got["diameter"], got["connected"]) == (1.333333, 2, True)
    assert got["numeric_assortativity"] == A.numeric_assortativity(nodes, edges, "id", "num").first()[0]
    found = A.label_propagation(nodes, edges, "id").collect()
    assert got["communities"] == len({r.community for r in found}) and got["communities_modularity"] is not None
    assert {f"{c}_{x}" for c in ("lgc", "harmonic") for x in ("precision", "recall", "f1")} <= got.keys()
    assert 0 <= got["lgc_recall"] <= 1


def test_paths(small):
    nodes, edges = small
    paths = G.shortest_paths(edges, nodes.where("id = 3").select(F.col("id").alias("source")))
    assert {r.node: r.dist for r in paths.collect()} == {3: 0, 2: 0.5, 1: 0.75, 0: 1.25}
    assert [r.node for r in G.context_nodes(paths, 2).orderBy("dist").collect()] == [1, 0]
    assert [r.node for r in G.context_nodes(paths, 2, "first").orderBy("dist").collect()] == [3, 2]
    with pytest.raises(ValueError):
        G.shortest_paths(edges.withColumn("weight", -F.col("weight")), nodes.select(F.col("id").alias("source")))


def test_threshold_drops_nan_and_self_edges(spark):
    e = spark.createDataFrame([(0, 1, float("nan")), (1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.6)], "src long, dst long, weight double")
    assert [r.dst for r in G.threshold_edges(e, 0.5).collect()] == [3]


def test_two_cliques_are_two_communities(spark):
    pairs = [(a, b) for base in (0, 5) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 5)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(10)], "id long")
    for found in (A.greedy_communities(nodes, edges, "id"), A.label_propagation(nodes, edges, "id")):
        got = {r.node: r.community for r in found.collect()}
        assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]


def test_labels_spread(spark, small):
    nodes, edges = small
    seeds = nodes.withColumn("label", F.when(F.col("id") == 0, "x").when(F.col("id") == 3, "y"))
    for harmonic in (False, True):
        got = {r.node: r.predicted for r in A.spread_labels(seeds, edges, "id", "label", rounds=5, harmonic=harmonic).collect()}
        assert got[1] == "x" and (got[0], got[3]) == ("x", "y") if harmonic else got[1] == "x"


def test_labels_reach_every_node_of_a_long_path(spark):
    """One seed at the end of a path of 12 nodes and two nodes apart: all have rows, the path its seed's label."""
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(11)] + [(20, 21, 1.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i, "x" if i == 0 else None) for i in [*range(12), 20, 21]], "id long, label string")
    for harmonic in (False, True):
        got = {r.node: r.predicted for r in A.spread_labels(nodes, edges, "id", "label", rounds=2, harmonic=harmonic, to_reach=True).collect()}
        assert got == {**{i: "x" for i in range(12)}, 20: None, 21: None}


def test_weighted_prf(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    assert tuple(A.weighted_prf(df, "t", "p").first()) == (round((2 * 1 + 1 / 3) / 4, 6), 0.5, round((2 * 2 / 3 + 0.5) / 4, 6))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    e = spark.createDataFrame([*path, *star, (5000, 5000), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(400)}, 5000: 5000}
    assert connected_components(e.limit(0)).count() == 0


def test_all_pairs_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(23, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(P, "BLOCK_ROWS", 5)
    got = {(r.src, r.dst): r.weight for r in P.all_pairs(df).collect()}
    want = {(i, j): round(float(v[i] @ v[j]), 6) for i in range(23) for j in range(i + 1, 23)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert P.all_pairs(df, both_ways=True).count() == 23 * 22
    assert P.all_pairs(df.limit(0)).count() == 0
    theta = P.theta_pairs(df.where("vec_id < 23"), "vec_id", S.DotScorer(), ["embedding"])
    assert theta.count() == len(want)


def test_top_k_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    a = P.vector_top_k(df, df, 3).orderBy("query_id", "rank").collect()
    b = P.vector_top_k(df, df, 3, block_rows=2).orderBy("query_id", "rank").collect()
    assert a == b and [r.node_id for r in a if r.query_id == 0] == [0, 1, 2] and [r.node_id for r in a if r.query_id == 2] == [2, 5, 8]


def test_stripes(spark):
    df = spark.range(1, 11).withColumn("i", F.col("id") - 1)
    got = {r.chunk: sorted(r.ids) for r in P.chunks(df, 3, "i").groupBy("chunk").agg(F.collect_list("id").alias("ids")).collect()}
    assert got == {0: [1, 4, 7, 10], 1: [2, 5, 8], 2: [3, 6, 9]}


def test_scaling_and_tuning(spark):
    e = spark.createDataFrame([(i, i + 1, float(w)) for i, w in enumerate([1, 2, 3, 4, 5])], "src long, dst long, weight double")
    assert [r.scaled for r in S.robust_scale(e).orderBy("weight").collect()] == [-1, -0.5, 0, 0.5, 1]
    flat = e.withColumn("weight", F.lit(2.0))
    assert {r.scaled for r in S.robust_scale(flat).collect()} == {0}
    assert T.tune_threshold(e).first().share == 0.2
    assert T.threshold_table(e.limit(0)).count() == 0
    nodes = spark.range(6).withColumnRenamed("id", "n")
    assert T.objective(nodes, e, "n", 9.0) == 10000
    assert T.objective(nodes, e, "n", 0.5) < T.objective(nodes, e, "n", 2.5)  # the second is not connected


def test_multi_criteria_search_stays_in_range(monkeypatch):
    monkeypatch.setattr(T, "objective", lambda nodes, edges, key, t: (t + 0.97) ** 2)
    best, value = T.tune_threshold_multi(None, None, "n")
    assert -1 <= best <= 2 and abs(best + 0.97) < 0.05 and value == (best + 0.97) ** 2


def test_principal_score(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 0.0) for i in range(5)], "x double, y double, z double")
    got = [r.weight for r in S.principal_score(df, ["x", "y", "z"], 1).orderBy("x").collect()]
    assert np.allclose(got, [(i - 2) * 5**0.5 for i in range(5)])


def test_best_match(spark):
    names = spark.createDataFrame([("policy report 2024",), ("zzz",)], "n string")
    meta = spark.createDataFrame([("Policy Report - 2024",), ("policy report",), ("Speech",)], "m string")
    got = {r.name: r.match for r in S.best_match(names, meta, "n", "m").collect()}
    assert got["policy report 2024"] == "Policy Report - 2024"
    assert {r.name: r.score for r in S.best_match(names, meta, "n", "m", 0.99).collect()}["zzz"] == -1


def test_best_match_in_blocks_agrees(spark):
    names = spark.createDataFrame([("alpha report",), ("Beta",), ("gama",), (None,), ("",)], "n string")
    meta = spark.createDataFrame([(m,) for m in ("Alpha Report", "alpha", "beta", "Beta", "gamma", "", None)], "m string")
    rows = lambda df: sorted(df.collect(), key=str)
    whole = rows(S.best_match(names, meta, "n", "m"))
    assert len(whole) == 5 and whole == rows(S.best_match(names, meta, "n", "m", block_rows=2))
    assert rows(S.best_match(names, meta.limit(0), "n", "m")) == [r for r in rows(S.best_match(names, meta, "n", "m", 2.0))]
