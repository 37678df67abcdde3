import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import analytics as A, connectivity as K


def graph(spark, n, pairs):
    nodes = spark.createDataFrame([(i * 2,) for i in range(n)], "vec_id long")
    edges = spark.createDataFrame([(a * 2, b * 2, 1.0) for a, b in pairs], "src long, dst long, weight double")
    return nodes.cache(), edges.cache()


def random_pairs(seed, n, share):
    rng = np.random.default_rng(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < share]


@pytest.mark.parametrize("seed, n, share", [(1, 12, 0.5), (2, 30, 0.2), (3, 70, 0.1), (4, 9, 1.0), (5, 6, 0.0), (6, 14, 0.12)])
def test_flows_are_those_of_the_driver(spark, seed, n, share):
    nodes, edges = graph(spark, n, random_pairs(seed, n, share))
    got = K.connectivity(nodes.union(nodes.limit(1)), edges.union(edges.limit(1)), "vec_id").first().asDict()
    assert got == A.connectivity(nodes, edges, "vec_id")


def test_flows_of_single_pairs_in_runs_of_targets():
    pairs = random_pairs(8, 90, 0.12)
    a, b = (np.array(x) for x in zip(*pairs))
    g = K.Arcs(np.r_[a, b], np.r_[b, a], 90)
    near = [{int(u): 1 for u in np.r_[b[a == v], a[b == v]]} for v in range(90)]
    for s in (0, 7):
        targets = np.array([t for t in range(90) if t != s])
        want = [A._max_flow(near, s, t) for t in targets]
        assert K.flows(g, s, targets, 1000, False).tolist() == want
        split = [{} for _ in range(180)]
        for v in range(90):
            split[2 * v][2 * v + 1] = 1
            split[2 * v + 1].update({2 * u: 1 for u in near[v]})
        assert K.flows(g, s, targets, 1000, True).tolist() == [A._max_flow(split, 2 * s + 1, 2 * t) for t in targets]
        assert K.flows(g, s, targets, 3, False).tolist() == [min(3, x) for x in want]


def test_a_graph_that_no_task_takes_in_has_the_same_flows(spark, monkeypatch):
    nodes, edges = graph(spark, 7, [(0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (3, 4), (3, 5), (4, 5), (0, 5)])
    monkeypatch.setattr(K, "TASK_ARCS", 0)
    assert K.connectivity(nodes.where("vec_id < 12"), edges, "vec_id").first().asDict() == A.connectivity(nodes.where("vec_id < 12"), edges, "vec_id")


def test_evaluation_tells_connectivity(spark):
    nodes, edges = graph(spark, 4, [(0, 1), (1, 2), (2, 3)])
    nodes = nodes.withColumn("label", F.col("vec_id") % 4)
    got = A.evaluate_graph(nodes, edges, "vec_id", "label").first()
    assert (got.avg_node_connectivity, got.node_connectivity, got.edge_connectivity) == (1.0, 1, 1)
