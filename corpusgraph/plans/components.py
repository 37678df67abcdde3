"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every end point; ``component`` is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour.  The graph contracts to stars in a logarithmic number of rounds; a round is two
    aggregations and two equi-joins on long keys, and is written so that no lineage builds up; the
    table of the round before is deleted.  It ends when a round changes no link.  Links, nodes and components never leave the executors.  Self-links only name a node.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b"))
    cur = materialize(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        nxt = materialize(small, "cc")
        now = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("h")).first()
        # equal counts and sums may be chance; the links themselves decide
        settled = now == seen and nxt.join(cur, ["a", "b"], "left_anti").isEmpty()
        discard(cur)
        cur, seen = nxt, now
        if settled:
            break
    root = cur.groupBy("a").agg(F.min("b").alias("component"))
    return (
        nodes.distinct().join(root.withColumnRenamed("a", "node"), "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )
