import random

from corpusgraph.operators import analytics as A, communities as C, tuning as T

E = "src long, dst long, weight double"


def graph(spark, n, edges):
    return spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, E)


def planted(rng, groups=6, size=12, inside=0.6, between=0.03):
    n = groups * size
    return n, [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a % groups == b % groups else between)]


def groups_of(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_communities_are_no_worse_than_greedy_merging_and_connected(spark):
    n, edges = planted(random.Random(3))
    nodes, e = graph(spark, n, edges)
    found = C.modular_communities(nodes, e, "id")
    label = {r.node: r.community for r in found.collect()}
    assert label == {i: i % 6 for i in range(n)}  # the planted ones, named by their smallest member
    q = A.modularity(e, found, "node", "community").first()[0]
    assert q >= A.modularity(e, A.greedy_communities(nodes, e, "id"), "node", "community").first()[0]


def test_random_graphs_and_odd_edges(spark):
    rng = random.Random(4)
    edges = [(a, b, round(rng.random(), 2)) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.12]
    nodes, e = graph(spark, 45, [*edges, (None, 3, 1.0), (4, None, 1.0), (5, 5, 9.0), (6, 7, None), (8, 9, -1.0)])
    found = C.modular_communities(nodes.union(nodes.limit(3)), e, "id").collect()
    label = {r.node: r.community for r in found}
    assert len(found) == 45 and all(label[i] == i for i in range(40, 45))
    inside = [(a, b, w) for a, b, w in edges if label[a] == label[b]]
    assert groups_of(45, inside) == [label[i] for i in range(45)]  # connected, named by the smallest
    unweighted = spark.createDataFrame([(a, b, w) for a, b, w in edges], E)
    q = A.modularity(unweighted, spark.createDataFrame(list(label.items()), "node long, community long"), "node", "community").first()[0]
    assert q > 0.2
    assert C.modular_communities(nodes.limit(0), e.limit(0), "id").count() == 0


def test_label_propagation_ends_where_labels_swing(spark):
    nodes, e = graph(spark, 2, [(0, 1, 1.0)])  # in step the two swap labels for ever
    assert sorted(map(tuple, A.label_propagation(nodes, e, "id").collect())) == [(0, 0), (1, 0)]
    path = [(i, i + 1, 1.0 + i / 100) for i in range(12)]
    nodes, e = graph(spark, 13, path)
    settled = A.label_propagation(nodes, e, "id")
    assert settled.count() == 13 and sorted(map(tuple, settled.collect())) == sorted(map(tuple, A.label_propagation(nodes, e, "id").collect()))
    assert len({r.community for r in A.label_propagation(nodes, e, "id", rounds=1).collect()}) > len({r.community for r in settled.collect()})


def test_forest_has_the_heaviest_edges(spark):
    rng = random.Random(5)
    edges = [(a, b, float(rng.randrange(8))) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.15]
    _, e = graph(spark, 30, [*edges, (1, 2, None), (3, 4, float("nan"))])
    got = C.maximum_forest(e).collect()
    root, want = list(range(30)), 0.0
    for a, b, w in sorted(edges, key=lambda x: -x[2]):
        x, y = (next(r for r in [v] for _ in [0]) for v in (a, b))
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        if x != y:
            root[x] = y
            want += w
    assert len(got) == len({(r.src, r.dst) for r in got}) == 30 - len(set(groups_of(30, edges))) and sum(r.weight for r in got) == want
    for t in range(8):
        over = [(r.src, r.dst, r.weight) for r in got if r.weight > t]
        assert groups_of(30, over) == groups_of(30, [x for x in edges if x[2] > t])


def test_profile_and_search_match_a_graph_for_each_point(spark):
    # what the search does with communities doesn't depend on how they are found
    find = lambda nodes, edges, key: A.components(nodes, edges, key).withColumnRenamed("component", "community")
    rng = random.Random(6)
    n, edges = planted(rng, 3, 8, 0.8, 0.2)
    nodes, e = graph(spark, n, [(a, b, round(rng.random() * (1 if a % 3 == b % 3 else 0.6), 3)) for a, b, _ in edges])
    got = T.threshold_profile(nodes, e, "id", points=5).orderBy("idx").collect()
    rows = [tuple(r) for r in e.collect()]
    for r in got:
        kept = [x for x in rows if x[2] > r.threshold]
        assert (r.n_edges, r.components, r.connected) == (len(kept), len(set(groups_of(n, kept))), len(set(groups_of(n, kept))) == 1)
        assert abs(r.avg_degree - 2 * len(kept) / n) < 1e-6
    best = T.tune_multi(nodes, e, "id", points=5, target_degree=5, find=find).first()

    def value(t):
        kept = e.where(e.weight > t)
        q = A.modularity(kept, find(nodes, kept, "id"), "node", "community").first()[0]
        r = next(x for x in got if x.threshold == t)
        return (5 - r.avg_degree) ** 2 + (0 if r.connected else 1000) - 10 * q

    assert abs(best.objective - min(value(r.threshold) for r in got if r.n_edges)) < 1e-5 and best.searched < 5
    assert T.tune_multi(nodes, e.limit(0), "id").count() == 0
