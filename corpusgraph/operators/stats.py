"""Tables behind the metric studies: summaries, correlations, samples, regressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.percentiles import percentiles
from corpusgraph.plans.positions import global_positions


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of each column (one row a column).

    Nulls are left out; a column without values has count 0 and nulls.
    """
    per = []
    for c in columns:
        x = F.col(c).cast("double")
        per.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.round(F.min(x), 6).alias("min"), F.round(F.max(x), 6).alias("max")))
    plain = df.agg(F.array(*per).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select("r.*")
    quartiles = percentiles(long, "value", [0.25, 0.5, 0.75], ["column"])
    q = [F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    # one row a column on both sides
    return plain.join(F.broadcast(quartiles), "column", "left").select("column", "count", "mean", "std", "min", *q, "max")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, r)`` of all column pairs, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")) for a, b in pairs]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("r")).select("r.*")


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct values, smallest and largest value (as text)."""
    rows = [
        F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("smallest"), F.max(c).cast("string").alias("largest"))
        for c in df.columns
    ]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("r")).select("r.*")


def distinct_values(df: DataFrame, items: Column) -> DataFrame:
    """``(value, n)``: the items of a list column and how often each occurs."""
    return df.select(F.explode(items).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def length_histogram(df: DataFrame, text: str, width: int = 1000) -> DataFrame:
    return df.groupBy((F.floor(F.length(text) / width) * width).alias("bucket")).agg(F.count("*").alias("n"))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows in the order of the key's MD5 (the same rows on every run)."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def sample_pairs(nodes: DataFrame, seq: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """``n`` pairs of different nodes, ``(draw, a, b)``, drawn by the MD5 of seed and draw; repeats may occur.

    Nodes are numbered in the order of ``seq``, and only the drawn numbers meet the nodes.  Fewer than two
    nodes give no pairs; nodes with a null ``seq`` take no part.
    """
    placed, total = global_positions(nodes.select(F.col(seq).alias("_seq")).where("_seq is not null"), ["_seq"], F.lit(1), "_at", "numbered")
    number = lambda side: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(f":{side}"))), 1, 8), 16, 10).cast("long")
    first = number("a") % max(total, 1)
    draws = nodes.sparkSession.range(n if total > 1 else 0).select(F.col("id").alias("draw"), first.alias("_a"), ((first + 1 + number("b") % max(total - 1, 1)) % max(total, 1)).alias("_b"))
    side = lambda at, name: placed.select(F.col("_at").alias(at), F.col("_seq").alias(name))
    return draws.join(side("_a", "a"), "_a").join(side("_b", "b"), "_b").select("draw", "a", "b")


def value_histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """``(bucket, n)``: how many values lie from ``bucket * width`` up to the next; nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bucket")).agg(F.count("*").alias("n"))


def leave_one_out_regressions(df: DataFrame, columns: list[str], seq: str, folds: int = 5) -> DataFrame:
    """Each column regressed on the others in contiguous folds: mean and deviation of the errors.

    Normal equations of all folds come from one aggregation of cross products (columns squared per
    fold); a fold's model is fitted on the sums of the other folds.
    """
    n_rows = df.count()
    cols = columns
    fold = F.floor(F.col("_i") * folds / F.lit(max(n_rows, 1))).cast("int")
    placed, _ = global_positions(df.select(F.col(seq).alias("_s"), *cols), ["_s"], F.lit(1), "_i", "folds")
    x = placed.withColumn("fold", fold)
    terms = [*cols, None]
    value = lambda c: F.lit(1.0) if c is None else F.col(c).cast("double")
    sums = [F.sum(value(a) * value(b)).alias(f"p{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    per = {r["fold"]: r for r in x.groupBy("fold").agg(*sums).collect()}
    k = len(terms)
    gram = {f: np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for f, r in per.items()}
    models = {}
    for t in range(len(cols)):
        keep = [i for i in range(k) if i != t]
        for f in gram:
            m = sum((g for o, g in gram.items() if o != f), np.zeros((k, k)))
            models[t, f] = np.linalg.lstsq(m[np.ix_(keep, keep)], m[keep, t], rcond=None)[0]
    errors = []
    for t, c in enumerate(cols):
        keep = [i for i in range(k) if i != t]
        guess = F.lit(None).cast("double")
        for f in gram:
            w = models[t, f]
            guess = F.when(F.col("fold") == f, sum((float(b) * value(terms[i]) for b, i in zip(w, keep, strict=True)), F.lit(0.0))).otherwise(guess)
        errors.append((guess - F.col(c), F.col(c)))
    aggs = []
    for t, (e, y) in enumerate(errors):
        aggs += [F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))).alias(f"a{t}"), F.avg(e * e).alias(f"b{t}")]
    scores = x.groupBy("fold").agg(*aggs)
    rows = [F.struct(F.lit(c).alias("target"), F.avg(f"a{t}").alias("mape_mean"), F.stddev_pop(f"a{t}").alias("mape_std"), F.avg(f"b{t}").alias("mse_mean"), F.stddev_pop(f"b{t}").alias("mse_std")) for t, c in enumerate(cols)]
    return scores.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("r")).select("r.*")
