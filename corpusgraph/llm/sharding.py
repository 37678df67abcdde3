"""Shards of near-equal size by sampled splitters."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.binding import bisect
from corpusgraph.plans.positions import long_array
from corpusgraph.plans.scratch import materialize

#: Ranges per shard at least; rows per range, which the number of ranges follows; and ranges at most.
RANGES_PER_SHARD, ROWS_PER_RANGE, MAX_RANGES = 8, 1_000_000, 20_000
SAMPLES_PER_RANGE = 24
ORDER = ("_h", "_k", "_u")


def _range_of(bounds: list[tuple[int, int, int]]) -> Column:
    """The number of splitters at or below a row."""
    # three constant arrays: a constant array of structs would be built anew for every row
    h, k, u = (long_array([b[i] for b in bounds]) for i in range(3))

    def below(i: Column) -> Column:
        same_h, same_k = F.get(h, i) == F.col("_h"), F.get(k, i) == F.col("_k")
        return (F.get(h, i) < F.col("_h")) | (same_h & ((F.get(k, i) < F.col("_k")) | (same_k & (F.get(u, i) <= F.col("_u")))))

    return bisect(len(bounds), below)


def _measure(rows: DataFrame, bounds: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """Of each range: weight, rows, and its heaviest row."""
    got = rows.groupBy(_range_of(bounds).alias("r")).agg(F.sum("_w").alias("w"), F.count("*").alias("n"), F.max("_w").alias("m")).collect()
    return {r["r"]: (r["w"], r["n"], r["m"]) for r in got}


def _quantiles(drawn: list, unit: float, mean: float) -> list[tuple[int, int, int]]:
    """Rows of a sorted sample at which a range of about ``mean`` is full; a row stands for ``unit`` at least."""
    out, held = [], 0.0
    for *at, w in drawn:
        own = max(w, unit)
        if held and held + own > mean:
            out.append(tuple(at))
            held = 0.0
        held += own
    return out


def _splitters(rows: DataFrame, weight: int, n_ranges: int) -> list[tuple[int, int, int]]:
    """Quantiles of a sample drawn by weight; ranges over twice the mean are subdivided until none is."""
    draw = F.xxhash64(F.lit("draw"), *ORDER).bitwiseAND(F.lit(2**53 - 1).cast("long")) / F.lit(float(2**53))
    mean, dense = weight / n_ranges, SAMPLES_PER_RANGE

    def sample(df: DataFrame) -> list[tuple[int, int, int]]:
        drawn = sorted(tuple(r) for r in df.where(draw < F.col("_w") * (dense / mean)).select(*ORDER, "_w").collect())
        return _quantiles(drawn, mean / dense, mean)

    bounds = sample(rows)
    # a row that outweighs its range can't be split: what counts is the weight beside it
    while over := [r for r, (w, _, m) in _measure(rows, bounds).items() if w - m > 2 * mean]:
        dense *= 2
        bounds = sorted({*bounds, *sample(rows.where(_range_of(bounds).isin(over)))})
    return bounds


def assign_shards(
    docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16, group_percent: int = 5,
) -> DataFrame:
    """Range-partition documents into ``n_shards`` shards of near-equal bytes (law ``bytes``).

    Order: hash of the text, then the key, so that equal texts are neighbours; rows that repeat
    both keep the order in which they were read.  A sample drawn with chances in proportion to the
    sizes (plus the mean size, so that many small rows count too) gives quantile splitters; the
    ranges between them grow in number with the rows, and those over twice the mean are subdivided
    from denser samples of their own rows until none is left.  A range that lies within a shard
    goes there whole.  A shard's border falls inside one range; there the running sum of the sizes
    splits it at the row where the border is, so no shard depends on the luck of the sample.  A
    group of equal texts of at most ``group_percent`` of a shard stays in the shard of its first
    row; of a larger one, only the rows within that length of its first row do.  No shard is off by
    more than that and one document.

    Nulls: a null text has no bytes (size = overhead); a null key sorts as the smallest long.
    Repeated rows are rows of their own.  An empty table gives an empty result; other columns don't
    stay.  The driver holds the sample, and the sums and end groups of at most MAX_RANGES ranges
    and their subdivisions; everything that decides a shard covers all rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(key).alias("doc_id"), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
            F.conv(F.substring(F.md5(F.encode(t, "UTF-8")), 1, 15), 16, 10).cast("long").alias("_h"),
            F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")).alias("_k"), F.monotonically_increasing_id().alias("_u"),
        ),
        "shard-keys",
    )
    size = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total, n = size["bytes"] or 0, size["n"]
    n_ranges = min(max(n_shards * RANGES_PER_SHARD, n // ROWS_PER_RANGE), MAX_RANGES)
    rows = rows.withColumn("_w", F.col("size") + total // max(n, 1))
    bounds = _splitters(rows, total + n * (total // max(n, 1)), n_ranges) if n else []
    inside = Window.partitionBy("_r").orderBy(*ORDER)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    first_of_group = F.coalesce(F.lag("_h").over(inside) != F.col("_h"), F.lit(True))
    ranged = materialize(
        rows.withColumn("_r", _range_of(bounds)).withColumn("_before", F.sum("size").over(so_far) - F.col("size")).withColumn("_rank", F.row_number().over(inside) - 1)
        .withColumn("_first", first_of_group).withColumn("_start", F.max(F.when(F.col("_first"), F.col("_before"))).over(so_far)).drop("_first", "_w"),
        "shard-ranges",
    )
    ends = {
        r["_r"]: r for r in ranged.groupBy("_r").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("_h").alias("low"), F.max("_h").alias("high"), F.max("_start").alias("start"),
        ).collect()
    }
    ids = range(len(bounds) + 1)
    byte_start = [0, *accumulate(ends[i]["bytes"] if i in ends else 0 for i in ids)]
    row_start = [0, *accumulate(ends[i]["n"] if i in ends else 0 for i in ids)]
    # a group that goes on from an earlier range starts there: one hash and one position a range
    carried, hash_, at = [], None, 0
    for i in ids:
        carried.append((hash_, at))
        if i in ends and ends[i]["high"] != hash_:
            hash_, at = ends[i]["high"], byte_start[i] + ends[i]["start"]
    r = F.col("_r")
    from_before = F.col("_h") == F.get(long_array([-1 if h is None else h for h, _ in carried]), r)
    before = F.get(long_array(byte_start), r) + F.col("_before")
    start = F.when(from_before, F.get(long_array([a for _, a in carried]), r)).otherwise(F.get(long_array(byte_start), r) + F.col("_start"))
    placed = ranged.withColumn("_at", before).withColumn("_group", start).withColumn("_place", F.get(long_array(row_start), r) + F.col("_rank"))
    limit = total * group_percent // (100 * n_shards)
    cut = F.when(F.col("_at") - F.col("_group") <= limit, F.col("_group")).otherwise(F.col("_at"))
    shards = placed.withColumn("_cut", cut).withColumn("shard", F.expr(f"cast(least({n_shards - 1}, _cut * {n_shards} div {max(total, 1)}) as int)"))
    firsts = {x["shard"]: x["f"] for x in shards.groupBy("shard").agg(F.min("_place").alias("f")).collect()}
    first = F.get(long_array([firsts.get(i, 0) for i in range(n_shards)]), F.col("shard"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
