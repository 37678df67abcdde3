"""Running totals over a global order without a single-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import materialize, shuffle_partitions


def long_array(values: list[int]) -> Column:
    """A constant array; one literal that the optimizer folds, however many values there are."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def global_positions(df: DataFrame, order: list[str], weight: Column, out: str, name: str = "ranged") -> tuple[DataFrame, int]:
    """Add ``out``: the sum of ``weight`` over all rows that precede a row in ``order``.

    Rows are range-partitioned on ``order`` (Spark samples the splitters), written once, summed
    per range, and each range's running total is shifted by the sum of the earlier ranges.  The
    driver only sees one number per range.  ``order`` should identify rows; rows that tie on it
    get consecutive positions in an unspecified order.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = materialize(
        df.withColumn("_w", weight.cast("long")).repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), name
    )
    sums = {r["_pid"]: r["s"] for r in ranged.groupBy("_pid").agg(F.sum("_w").alias("s")).collect()}
    last = max(sums, default=-1)
    totals = [sums.get(i, 0) or 0 for i in range(last + 1)]
    starts = [0, *accumulate(totals)][: last + 1]
    before = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.get(long_array(starts), F.col("_pid")) + F.coalesce(F.sum("_w").over(before), F.lit(0).cast("long"))
    return ranged.withColumn(out, at).drop("_pid", "_w"), sum(totals)
