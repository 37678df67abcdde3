"""Edge-threshold tuning."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators import analytics, communities, vector_communities, vector_graph
from corpusgraph.operators.graph import threshold_edges
from corpusgraph.operators.vector_graph import VectorGraph
from corpusgraph.plans.scratch import materialize

GRID, TARGET_SHARE, TARGET_DEGREE = 50, 0.2, 10
#: Edges of a graph of at most this average degree are written; their number grows with the nodes.
MOST_DEGREE = 64


def threshold_table(edges: DataFrame, points: int = GRID, digits: int = 6) -> DataFrame:
    """``(idx, threshold, share)``: the share of weights strictly over each of ``points`` even steps.

    Two passes: the range, then all counts at once.  NaN and null weights are left out.
    """
    w = edges.select("weight").where("weight is not null and not isnan(weight)")
    lo, hi = w.agg(F.min("weight"), F.max("weight")).first()
    if lo is None:
        return w.sparkSession.createDataFrame([], "idx int, threshold double, share double")
    at = _grid(lo, hi, points, digits)
    counts = w.agg(F.count("*").alias("n"), *[F.count_if(F.col("weight") > t).alias(f"c{i}") for i, t in enumerate(at)])
    rows = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(t).alias("threshold"), F.round(F.col(f"c{i}") / F.col("n"), digits).alias("share")) for i, t in enumerate(at)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def _grid(lo: float, hi: float, points: int, digits: int) -> list[float]:
    return [round(lo + i * ((hi - lo) / (points - 1)), digits) for i in range(points)]


def product_threshold_table(nodes: DataFrame, seq: str, vector: str = "embedding", points: int = GRID, digits: int = 6) -> DataFrame:
    """``threshold_table`` of the products of all pairs, of which none is written: two rounds of blocks that meet (``vector_graph.PairWeights``).

    Fewer than two nodes with vectors give no rows.
    """
    h = vector_graph.PairWeights(nodes, seq, vector, digits)
    spark, unit = nodes.sparkSession, 10.0**digits
    if not h.n:
        return spark.createDataFrame([], "idx int, threshold double, share double")
    at = _grid(h.lo / unit, h.hi / unit, points, digits)
    bound = [round(t * unit) for t in at]
    step = vector_graph._STEP
    x, k = h.inside([b >> step for b in bound])
    over = [int(h.count[h.step > b >> step].sum() + k[(x >> step == b >> step) & (x > b)].sum()) for b in bound]
    rows = spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate(zip(at, over, strict=True))], "idx int, threshold double, k long")
    return rows.select("idx", "threshold", F.round(F.col("k") / h.n, digits).alias("share"))


def best_threshold(table: DataFrame, share: float = TARGET_SHARE) -> DataFrame:
    """The row of a threshold table that keeps nearest to ``share`` of the edges (the first of equals)."""
    return table.agg(F.min_by(F.struct("threshold", "share"), F.struct(F.round(F.abs(F.col("share") - share), 6), F.col("idx"))).alias("b")).select("b.*")


def tune_threshold(edges: DataFrame, share: float = TARGET_SHARE, points: int = GRID) -> DataFrame:
    """The grid point that keeps nearest to ``share`` of the edges (the first of equals)."""
    return best_threshold(threshold_table(edges, points), share)


def threshold_profile(nodes: DataFrame, edges: DataFrame, key: str, points: int = GRID, digits: int = 6) -> DataFrame:
    """``(idx, threshold, n_edges, avg_degree, components, connected)`` at every grid point, without a graph for each.

    One pass counts the edges over all points; the components at a point are the nodes less the edges
    of the heaviest spanning forest over it, so one forest serves all.  Nodes count once, null ones not.
    """
    edges = materialize(edges.select("src", "dst", "weight").where("src <> dst and weight is not null and not isnan(weight)"), "profile-edges")
    lo, hi = edges.agg(F.min("weight"), F.max("weight")).first()
    schema = "idx int, threshold double, n_edges long, avg_degree double, components long, connected boolean"
    if lo is None:
        return nodes.sparkSession.createDataFrame([], schema)
    at = _grid(lo, hi, points, digits)
    ends = nodes.select(F.col(key).alias("n")).where("n is not null").distinct()
    known = communities.maximum_forest(edges.join(ends, edges["src"] == ends["n"], "left_semi").join(ends, edges["dst"] == ends["n"], "left_semi"))
    return _profile_rows(ends, _over(edges, at, "e"), known, at, digits)


def vector_profile(g: VectorGraph, points: int = GRID, digits: int = 6) -> DataFrame:
    """``threshold_profile`` of a graph whose edges are never written: blocks count them, and return their forests."""
    span = vector_graph.totals(g).first()
    schema = "idx int, threshold double, n_edges long, avg_degree double, components long, connected boolean"
    if span.lo is None:
        return g.nodes.sparkSession.createDataFrame([], schema)
    at = _grid(span.lo, span.hi, points, digits)
    known = communities.maximum_forest(vector_graph.forest_edges(g))
    ends = g.nodes.select(F.col(g.key).alias("n")).where("n is not null").distinct()
    return _profile_rows(ends, vector_graph.profile(g, at), known, at, digits)


def _over(edges: DataFrame, at: list[float], name: str) -> DataFrame:
    return edges.agg(F.array(*[F.count_if(F.col("weight") > t) for t in at]).alias(name))


def _profile_rows(ends: DataFrame, counted: DataFrame, known: DataFrame, at: list[float], digits: int) -> DataFrame:
    both = counted.crossJoin(_over(known, at, "f")).crossJoin(ends.agg(F.count("*").alias("n")))
    rows = both.select("n", F.posexplode(F.arrays_zip("e", "f", F.array(*map(F.lit, at)).alias("t"))).alias("idx", "x"))
    n, left = F.col("n"), F.col("n") - F.col("x.f")
    return rows.select("idx", F.col("x.t").alias("threshold"), F.col("x.e").alias("n_edges"), F.round(F.try_divide(2 * F.col("x.e"), n), digits).alias("avg_degree"), left.alias("components"), (left == 1).alias("connected"))


def tune_multi(nodes: DataFrame, edges: DataFrame, key: str, points: int = GRID, target_degree: float = TARGET_DEGREE, find: Callable[[DataFrame, DataFrame, str], DataFrame] = analytics.label_propagation) -> DataFrame:
    """One row ``(threshold, objective, avg_degree, connected, modularity, searched)``: the grid point of the least objective.

    The objective is the squared miss of the average degree, 1000 if the graph falls apart, less ten
    times the modularity of its communities; 10000 for a point without edges.  The first two parts are known for all points at once;
    as modularity is at most 1, communities are sought (``searched`` times) only at points that can still win, the best bound
    first.  ``find`` seeks them: label propagation, as ``objective`` does, or ``modular_communities``, which finds better
    ones in more rounds.  Ties go to the smaller threshold.
    """
    edges = materialize(edges.select("src", "dst", "weight"), "tune-edges")

    def value(t: float) -> float | None:
        kept = threshold_edges(edges, t)
        return analytics.modularity(kept, find(nodes, kept, key), "node", "community").first()[0]

    return _best_point(threshold_profile(nodes, edges, key, points), target_degree, value)


def vector_tune_multi(g: VectorGraph, points: int = GRID, target_degree: float = TARGET_DEGREE, most_degree: float = MOST_DEGREE) -> DataFrame:
    """``tune_multi`` of a graph of which no more than ``most_degree / 2`` edges a node are ever written, by label propagation.

    The profile tells how many edges a point has.  Where these are few, as they are near a small target, they are
    written once and labels spread along them; where not, labels spread between blocks of vectors.
    """
    profile = materialize(vector_profile(g, points), "profile")
    few = {r.threshold for r in profile.where(F.col("avg_degree") <= most_degree).collect()}
    written: list[tuple[float, DataFrame]] = []

    def value(t: float) -> float | None:
        over = g._replace(threshold=max(t, g.threshold))
        if t not in few:
            return vector_communities.modularity(over, vector_communities.label_propagation(over)).first()[0]
        if not written or t < written[-1][0]:
            written.append((t, materialize(vector_graph.edges(over), "tune-edges")))
        kept = threshold_edges(written[-1][1], t)
        return analytics.modularity(kept, analytics.label_propagation(g.nodes, kept, g.key), "node", "community").first()[0]

    return _best_point(profile, target_degree, value)


def _best_point(profile: DataFrame, target_degree: float, value: Callable[[float], float | None]) -> DataFrame:
    table = profile.collect()
    known = sorted(((target_degree - r.avg_degree) ** 2 + (0 if r.connected else 1000), r.threshold, r) for r in table if r.n_edges)
    best, searched = None, 0
    for rough, t, r in known:
        if best is not None and rough - 10 >= best[0]:
            break
        q = value(t) or 0.0
        searched += 1
        got = (round(rough - 10 * q, 6), t, r, q)
        best = got if best is None or got[:2] < best[:2] else best
    schema = "threshold double, objective double, avg_degree double, connected boolean, modularity double, searched int"
    if best is None:
        rows = [(min(r.threshold for r in table), 10000.0, 0.0, False, None, 0)] if table else []
    else:
        rows = [(best[1], best[0], best[2].avg_degree, best[2].connected, best[3], searched)]
    return profile.sparkSession.createDataFrame(rows, schema)


def vector_objective(g: VectorGraph, target_degree: float = TARGET_DEGREE) -> float:
    """``objective`` of a graph whose edges are never written."""
    m, n = vector_graph.totals(g).first().n, g.nodes.count()
    if not m or not n:
        return 10000.0
    connected = analytics.is_connected(g.nodes, materialize(vector_graph.forest_edges(g), "forest"), g.key).first()[0]
    q = vector_communities.modularity(g, vector_communities.label_propagation(g)).first()[0]
    return (target_degree - round(2 * m / n, 6)) ** 2 + (0 if connected else 1000) - 10 * (q or 0.0)


def objective(nodes: DataFrame, edges: DataFrame, key: str, threshold: float, target_degree: float = TARGET_DEGREE) -> float:
    """Squared miss of the average degree, 1000 if not connected, less 10 times the modularity of
    the communities found; 10000 for a graph without edges."""
    kept = threshold_edges(edges, threshold)
    stats = analytics.quick_stats(nodes, kept).first()
    if not stats["n_edges"] or not stats["n_nodes"]:
        return 10000.0
    connected = analytics.is_connected(nodes, kept, key).first()[0]
    found = analytics.label_propagation(nodes, kept, key)
    q = analytics.modularity(kept, found, "node", "community").first()[0]
    return (target_degree - stats["avg_degree"]) ** 2 + (0 if connected else 1000) - 10 * (q or 0.0)


def tune_threshold_multi(nodes: DataFrame, edges: DataFrame, key: str, low: float = -1.0, high: float = 2.0, evaluations: int = 25) -> tuple[float, float]:
    """Threshold of the least objective within ``low`` and ``high``: an even search, narrowed twice
    around the best point."""
    tried: dict[float, float] = {}

    def visit(points: Iterable[float]) -> None:
        for t in points:
            if t not in tried:
                tried[t] = objective(nodes, edges, key, t)

    per, span = max(3, evaluations // 3), high - low
    centre = (low + high) / 2
    for _ in range(3):
        visit(min(high, max(low, round(centre - span / 2 + i * span / (per - 1), 6))) for i in range(per))
        centre = min(tried, key=lambda t: (tried[t], t))
        span /= 4
    best = min(tried, key=lambda t: (tried[t], t))
    return best, tried[best]
