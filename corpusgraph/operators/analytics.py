"""Statistics of a similarity graph."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from corpusgraph.operators import connectivity as flows
from corpusgraph.operators.communities import modular_communities
from corpusgraph.operators.graph import shortest_paths, symmetric
from corpusgraph.plans.components import connected_components
from corpusgraph.plans.positions import global_positions
from corpusgraph.plans.scratch import materialize, shuffle_partitions


def quick_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average degree, density (null where there are too few nodes)."""
    n, e = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    v, m = F.col("n_nodes"), F.col("n_edges")
    return n.crossJoin(e).select("n_nodes", "n_edges", F.round(F.try_divide(2 * m, v), 6).alias("avg_degree"), F.round(F.try_divide(2 * m, v * (v - 1)), 6).alias("density"))


def degrees(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    d = symmetric(edges).groupBy("src").agg(F.count("*").alias("degree"))
    return nodes.select(F.col(key).alias("node")).join(d, F.col("node") == F.col("src"), "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Degree over nodes less one, and the same scaled to 0..1 over the graph."""
    return centrality(degrees(nodes, edges, key))


def centrality(d: DataFrame) -> DataFrame:
    """``degree_centrality`` of ``(node, degree)``."""
    stats = d.agg(F.count("*").alias("n"), F.min("degree").alias("lo"), F.max("degree").alias("hi"))
    d = d.crossJoin(F.broadcast(stats))
    return d.select("node", F.round(F.try_divide(F.col("degree"), F.col("n") - 1), 6).alias("centrality"), F.round(F.try_divide(F.col("degree") - F.col("lo"), F.col("hi") - F.col("lo")), 6).alias("scaled"))


def clustering(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Clustering coefficient of every node (0 below two neighbours).

    Edges point from the end of lower degree, so that a hub opens few wedges.
    """
    d = materialize(degrees(nodes, edges, key), "degrees")
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), d.select(F.col("node").alias("dst"), F.col("degree").alias("dd"))
    e = edges.select("src", "dst").join(a, "src").join(b, "dst")
    forward = F.struct("ds", "src") < F.struct("dd", "dst")
    e = e.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("y"))
    wedge = e.alias("p").join(e.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.y").alias("z"))
    closed = e.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
    triangles = wedge.join(closed, ["y", "z"]).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    ratio = F.coalesce(F.try_divide(2 * F.col("t"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0))
    return d.join(triangles, "node", "left").select("node", "degree", F.coalesce("t", F.lit(0)).alias("triangles"), ratio.alias("clustering"))


def average_clustering(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return clustering(nodes, edges, key).agg(F.round(F.avg("clustering"), 6).alias("avg_clustering"))


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``(node, component)`` of all nodes, named by the smallest node reachable."""
    c = connected_components(edges)
    return nodes.select(F.col(key).alias("_n")).join(c, F.col("_n") == F.col("node"), "left").select(F.col("_n").alias("node"), F.coalesce("component", "_n").alias("component"))


def is_connected(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return components(nodes, edges, key).agg((F.count_distinct("component") == 1).alias("connected"))


def path_stats(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Average shortest path length and diameter in hops; null if the graph is not connected."""
    paths = shortest_paths(edges, nodes.select(F.col(key).alias("source")), weighted=False)
    stats = paths.where("source <> node").agg(F.count("*").alias("pairs"), F.avg("dist").alias("a"), F.max("dist").alias("d"))
    n = nodes.agg(F.count("*").alias("n"))
    full = F.col("pairs") == F.col("n") * (F.col("n") - 1)
    return stats.crossJoin(n).select(F.when(full, F.round("a", 6)).alias("avg_shortest_path"), F.when(full, F.col("d").cast("long")).alias("diameter"))


def _ends(edges: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    v = values.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    both = symmetric(edges)
    return both.join(v.withColumnsRenamed({"_k": "src", "_v": "x"}), "src").join(v.withColumnsRenamed({"_k": "dst", "_v": "y"}), "dst")


def degree_assortativity(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return _ends(edges, degrees(nodes, edges, key), "node", "degree").agg(F.round(F.corr("x", "y"), 6).alias("degree_assortativity"))


def numeric_assortativity(nodes: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    return _ends(edges, nodes.withColumn("_num", F.col(value).cast("double")), key, "_num").agg(F.round(F.corr("x", "y"), 6).alias("numeric_assortativity"))


def attribute_assortativity(nodes: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """``(trace - |M^2|) / (1 - |M^2|)`` of the normalised mixing matrix."""
    counts = _ends(edges, nodes, key, value).groupBy("x", "y").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("m"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("c"))), F.lit(0)).alias("t"))
    a = counts.groupBy("x").agg(F.sum("c").alias("a")).crossJoin(F.broadcast(total)).agg(F.sum((F.col("a") / F.col("m")) * (F.col("a") / F.col("m"))).alias("s"))
    return total.crossJoin(a).select(F.round(F.try_divide(F.col("t") / F.col("m") - F.col("s"), 1 - F.col("s")), 6).alias("attribute_assortativity"))


def modularity(edges: DataFrame, membership: DataFrame, key: str, community: str) -> DataFrame:
    """Weighted modularity of a given partition."""
    ends = _ends(edges, membership, key, community)
    per = ends.groupBy("x").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0)).alias("inside"))
    total = per.agg(F.sum("k").alias("m2"))
    part = F.col("inside") / F.col("m2") - (F.col("k") / F.col("m2")) * (F.col("k") / F.col("m2"))
    return per.crossJoin(F.broadcast(total)).agg(F.round(F.sum(part), 6).alias("modularity"))


def label_propagation(nodes: DataFrame, edges: DataFrame, key: str, rounds: int | None = None) -> DataFrame:
    """``(node, community)``: every node takes its neighbours' heaviest label, in step (ties to the smaller).

    Goes on until no label changes, or for ``rounds`` if given.  Nodes that take labels in step may
    swing for ever; when a state of the labels comes back, each node gets the smallest label that
    it holds within the cycle.  Nodes without edges keep their own label; null nodes and ends, and
    edges without a weight, count for nothing; repeated nodes count once.
    """
    both = materialize(symmetric(edges).where("src is not null and dst is not null and weight is not null"), "lp-edges")
    # dealt by source once, so that a round's join moves labels only
    both = both.repartition(shuffle_partitions(both.sparkSession), "src").persist(StorageLevel.DISK_ONLY)

    def step(labels: DataFrame) -> DataFrame:
        heard = both.join(labels, both["src"] == labels["node"]).select("dst", "community", F.col("weight").alias("w"))
        own = labels.select(F.col("node").alias("dst"), "community", F.lit(1e-9).alias("w"))
        # votes travel once, to their node, which serves both sums
        votes = heard.union(own).repartition("dst").groupBy("dst", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("dst").agg(F.min_by("community", F.struct(-F.round("w", 9), F.col("community"))).alias("community"))
        return best.select(F.col("dst").alias("node"), "community")

    try:
        return settle(nodes.select(F.col(key).alias("node")), step, rounds)
    finally:
        both.unpersist()


def settle(nodes: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int | None) -> DataFrame:
    """Labels ``(node, community)`` after ``step`` has been taken until none changes or a state comes back, or for ``rounds``."""
    states = [materialize(nodes.select("node", F.col("node").alias("community")).where("node is not null").distinct(), "lp")]
    seen = [_state(states[0])]
    while rounds is None or len(states) <= rounds:
        labels = states[-1]
        new = materialize(step(labels), "lp")
        now = _state(new)
        # equal sums may be chance; the labels themselves decide
        for i in [i for i, s in enumerate(seen) if s == now]:
            if new.join(states[i].withColumnRenamed("community", "old"), "node").where("community <> old").isEmpty():
                if i == len(states) - 1:
                    return states[i]
                cycle = states[i]
                for more in states[i + 1 :]:
                    cycle = cycle.union(more)
                return materialize(cycle.groupBy("node").agg(F.min("community").alias("community")), "lp")
        states.append(new)
        seen.append(now)
    return states[-1]


def _state(labels: DataFrame) -> tuple:
    """A sum that tells most states of labels apart."""
    return tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("node", "community") % 1000003), F.sum(F.xxhash64("community", "node") % 998244353)).first())


MAX_DRIVER_NODES = 2000


def _adjacency(nodes: DataFrame, edges: DataFrame, key: str) -> tuple[list, list[dict]]:
    """A small graph in memory; refused beyond MAX_DRIVER_NODES nodes."""
    ids = [r[0] for r in nodes.select(key).orderBy(key).limit(MAX_DRIVER_NODES + 1).collect()]
    if len(ids) > MAX_DRIVER_NODES:
        raise ValueError(f"this statistic has no distributed form; it takes {MAX_DRIVER_NODES} nodes at most")
    at = {v: i for i, v in enumerate(ids)}
    near: list[dict] = [{} for _ in ids]
    for r in edges.select("src", "dst", "weight").collect():
        near[at[r[0]]][at[r[1]]] = near[at[r[1]]][at[r[0]]] = r[2]
    return ids, near


def greedy_communities(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Greedy modularity merging (unweighted) of a small graph; ``(node, community)``.

    The pair of communities whose merger gains most is merged until none gains; ties go to the
    pair with the smallest members.  Use ``modular_communities`` for large graphs.
    """
    ids, near = _adjacency(nodes, edges, key)
    m = sum(len(x) for x in near) / 2
    of = list(range(len(ids)))
    if m:
        share = {i: len(near[i]) / (2 * m) for i in of}
        gain = {i: {j: 1 / m - 2 * share[i] * len(near[j]) / (2 * m) for j in near[i]} for i in of}
        while True:
            best = max(((g, -i, -j) for i, row in gain.items() for j, g in row.items() if i < j), default=None)
            if best is None or best[0] <= 0:
                break
            i, j = -best[1], -best[2]
            for k in (gain[i].keys() | gain[j].keys()) - {i, j}:
                a, b = gain[i].get(k), gain[j].get(k)
                g = a + b if a is not None and b is not None else a - 2 * share[j] * share[k] if b is None else b - 2 * share[i] * share[k]
                gain[i][k] = gain[k][i] = g
                gain[k].pop(j, None)
            gain[i].pop(j, None)
            del gain[j]
            share[i] += share.pop(j)
            of = [i if c == j else c for c in of]
    spark = nodes.sparkSession
    return spark.createDataFrame([(ids[v], ids[c]) for v, c in enumerate(of)], f"node {nodes.schema[key].dataType.simpleString()}, community {nodes.schema[key].dataType.simpleString()}")


def _max_flow(capacity: list[dict[int, int]], s: int, t: int) -> int:
    """Unit augmentations along shortest residual paths."""
    residual, flow = [dict(c) for c in capacity], 0
    while True:
        came, todo = {s: s}, deque([s])
        while todo and t not in came:
            u = todo.popleft()
            for v, c in residual[u].items():
                if c > 0 and v not in came:
                    came[v] = u
                    todo.append(v)
        if t not in came:
            return flow
        v = t
        while v != s:
            u = came[v]
            residual[u][v] -= 1
            residual[v][u] = residual[v].get(u, 0) + 1
            v = u
        flow += 1


def connectivity(nodes: DataFrame, edges: DataFrame, key: str) -> dict[str, float | int]:
    """Average node connectivity, node and edge connectivity of a small graph, by maximum flows."""
    ids, near = _adjacency(nodes, edges, key)
    n = len(ids)
    if n < 2:
        return {"avg_node_connectivity": 0.0, "node_connectivity": 0, "edge_connectivity": 0}
    split: list[dict[int, int]] = [{} for _ in range(2 * n)]  # v enters at 2v and leaves at 2v + 1
    for v in range(n):
        split[2 * v][2 * v + 1] = 1
        for u in near[v]:
            split[2 * v + 1][2 * u] = 1
    node = {(s, t): _max_flow(split, 2 * s + 1, 2 * t) for s in range(n) for t in range(s + 1, n)}
    edge = [_max_flow([{u: 1 for u in x} for x in near], 0, t) for t in range(1, n)]
    apart = [f for (s, t), f in node.items() if t not in near[s]]
    return {"avg_node_connectivity": round(sum(node.values()) / len(node), 6), "node_connectivity": min(apart, default=n - 1), "edge_connectivity": min(edge)}


def spread_labels(nodes: DataFrame, edges: DataFrame, key: str, label: str, alpha: float = 0.99, rounds: int = 30, harmonic: bool = False, digits: int = 9, to_reach: bool = False) -> DataFrame:
    """``(node, predicted)`` by local and global consistency, or by the harmonic function.

    Scores ``(node, label, f)`` go along edges for a fixed number of rounds: normalised by both
    ends' strengths and mixed with the seeds, or (``harmonic``) averaged over neighbours with seeds
    held.  Nodes with a null label are predicted like the others but seed nothing.  ``to_reach``
    goes on after the last round until no node is newly reached.  A node that no seed has reached
    has a row with a null prediction.
    """
    both = symmetric(edges)
    strength = both.groupBy("src").agg(F.sum("weight").alias("s"))
    w: Column = F.col("weight") / F.col("s") if harmonic else F.col("weight") / F.sqrt(F.col("s") * F.col("s2"))
    norm = both.join(strength, "src").join(strength.withColumnsRenamed({"src": "dst", "s": "s2"}), "dst").select("src", "dst", w.alias("w"))
    norm = materialize(norm, "spread-edges")
    seeds = nodes.where(F.col(label).isNotNull()).select(F.col(key).alias("node"), F.col(label).alias("label"), F.lit(1.0).alias("f"))
    seeds = materialize(seeds, "spread-seeds")
    f, done, reached = seeds, 0, -1
    while done < rounds or to_reach:
        if done >= rounds - 1 and to_reach:
            # scores only spread: a round that reaches nothing new is followed by none that does
            before, reached = reached, f.count()
            if done >= rounds and before == reached:
                break
        sent = norm.join(f, norm["dst"] == f["node"]).groupBy(F.col("src").alias("node"), "label").agg(F.sum(F.col("w") * F.col("f")).alias("f"))
        if harmonic:
            f = sent.join(seeds.select("node"), "node", "left_anti").union(seeds)
        else:
            f = sent.withColumn("f", alpha * F.col("f")).union(seeds.withColumn("f", (1 - alpha) * F.col("f"))).groupBy("node", "label").agg(F.sum("f").alias("f"))
        f = materialize(f, "spread")
        done += 1
    best = F.min_by("label", F.struct(-F.round("f", digits), F.col("label")))
    found = f.groupBy("node").agg(best.alias("predicted"))
    return nodes.select(F.col(key).alias("node")).where("node is not null").distinct().join(found, "node", "left")


def weighted_prf(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 per label, weighted by support (0 where undefined)."""
    cm = pairs.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    support = cm.groupBy(F.col("t").alias("l")).agg(F.sum("c").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"))
    said = cm.groupBy(F.col("p").alias("l")).agg(F.sum("c").alias("said"))
    x = support.join(said, "l", "left")
    p, r = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    x = x.select("support", p.alias("p"), r.alias("r")).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6)
    return x.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))


def evaluate_graph(nodes: DataFrame, edges: DataFrame, key: str, attribute: str) -> DataFrame:
    """One row of statistics; one that is undefined for the graph is null.

    Counts, clustering, paths, assortativities (the numeric one where ``attribute`` is a number),
    the modularity of ``attribute`` and of communities by label propagation, and precision, recall
    and F1 of both node classifiers: ``lgc_`` on all labels, ``harmonic_`` on every fifth node by
    hash, whose label it does not see; ``merged_`` are the communities of greatest modularity found
    (``modular_communities``).  Connectivity is of all pairs, by maximum flows in tasks.
    """
    edges = materialize(edges, "graph-edges")
    out = quick_stats(nodes, edges)
    found = materialize(label_propagation(nodes, edges, key), "graph-communities")
    merged = materialize(modular_communities(nodes, edges, key, patience=1), "graph-communities")
    hidden = F.pmod(F.xxhash64(key), F.lit(5)) == 0

    def prf(prefix: str, seen: DataFrame, judged: DataFrame, harmonic: bool) -> DataFrame:
        guess = spread_labels(seen, edges, key, attribute, harmonic=harmonic, to_reach=True)
        scores = weighted_prf(judged.where(F.col(attribute).isNotNull()).join(guess, judged[key] == guess["node"]), attribute, "predicted")
        return scores.select(*[F.col(c).alias(f"{prefix}_{c}") for c in scores.columns])

    parts = [
        average_clustering(nodes, edges, key), is_connected(nodes, edges, key), path_stats(nodes, edges, key), flows.connectivity(nodes, edges, key), degree_assortativity(nodes, edges, key),
        attribute_assortativity(nodes, edges, key, attribute), modularity(edges, nodes, key, attribute),
        found.agg(F.count_distinct("community").alias("communities")), modularity(edges, found, "node", "community").withColumnRenamed("modularity", "communities_modularity"),
        merged.agg(F.count_distinct("community").alias("merged_communities")), modularity(edges, merged, "node", "community").withColumnRenamed("modularity", "merged_modularity"),
        prf("lgc", nodes, nodes, False), prf("harmonic", nodes.withColumn(attribute, F.when(~hidden, F.col(attribute))), nodes.where(hidden), True),
    ]
    if isinstance(nodes.schema[attribute].dataType, NumericType):
        parts.append(numeric_assortativity(nodes, edges, key, attribute))
    else:
        parts.append(quick_stats(nodes, edges).select(F.lit(None).cast("double").alias("numeric_assortativity")))
    for p in parts:
        out = out.crossJoin(p)
    return out


def colour_nodes(nodes: DataFrame, membership: DataFrame, key: str) -> DataFrame:
    """Nodes with a dense colour number per community, by the community's order (numbered over ranges)."""
    colours, _ = global_positions(membership.select("community").distinct(), ["community"], F.lit(1), "colour", "graph-colours")
    return nodes.join(membership.withColumnRenamed("node", "_m"), nodes[key] == F.col("_m"), "left").drop("_m").join(colours.withColumn("colour", F.col("colour").cast("int")), "community", "left")
