"""Exact percentiles without one task that holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.positions import global_positions
from corpusgraph.plans.scratch import materialize
from corpusgraph.plans.skew import join_groups


def percentiles(df: DataFrame, value: str, at: list[float], by: list[str] | None = None) -> DataFrame:
    """``(by..., n, q)``: how many values there are, and their interpolated percentiles ``at`` as doubles.

    Equal values are counted before anything is shuffled; values then get positions in the order of
    the whole table, and only the two beside each percentile are gathered.  Null values are left
    out; NaN comes after all numbers; null keys make a group.  Without ``by`` there is always one
    row, whose percentiles are null for a table without values.
    """
    by = by or []
    group = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    counted = df.select(group.alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy("_g", "_v").agg(F.count("*").alias("_k"))
    placed, _ = global_positions(counted, ["_g", "_v"], F.col("_k"), "_at", "percentiles")
    groups = placed.groupBy("_g").agg(F.count("*").alias("rows"), F.min("_at").alias("_first"), F.sum("_k").alias("n"))
    rows = join_groups(placed, materialize(groups, "groups"), ["_g"], "rows")
    lower = F.col("_at") - F.col("_first")
    aggs = []
    for i, q in enumerate(at):
        rank = F.lit(float(q)) * (F.col("n") - 1)
        for name, r in ((f"lo{i}", F.floor(rank)), (f"hi{i}", F.ceil(rank))):
            aggs.append(F.max(F.when((lower <= r) & (r < lower + F.col("_k")), F.col("_v"))).alias(name))
    found = rows.groupBy("_g", "n").agg(*aggs)

    def between(i: int, q: float):
        rank, lo, hi = F.lit(float(q)) * (F.col("n") - 1), F.col(f"lo{i}"), F.col(f"hi{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(rank) - rank) * lo + (rank - F.floor(rank)) * hi)

    out = found.select("_g", "n", F.array(*[between(i, q) for i, q in enumerate(at)]).alias("q"))
    if by:
        return out.select(*[F.col("_g")[c].alias(c) for c in by], "n", "q")
    empty = F.array(*[F.lit(None).cast("double") for _ in at])
    return out.agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.first("q", ignorenulls=True), empty).alias("q"))
