"""Scorers over whole tables: token relevance, set overlap, robust scaling, principal components."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import metrics, text
from corpusgraph.operators import fuzzy
from corpusgraph.operators.search import share, sparse_top_k
from corpusgraph.plans.percentiles import percentiles
from corpusgraph.plans.scratch import materialize
from corpusgraph.plans.skew import join_groups

# Fixed values of the relevance formula.
K1, B, NEGATIVE_IDF_SHARE = 1.5, 0.75, 0.25


class Scorer(Protocol):
    """A user-defined scorer: the columns it needs of each node, and a score over prefixed columns."""

    columns: list[str]

    def __call__(self, a: str, b: str) -> Column: ...


class DotScorer:
    """Dot product of the text vectors."""

    def __init__(self, vector: str = "embedding"):
        self.vector, self.columns = vector, [vector]

    def __call__(self, a: str, b: str) -> Column:
        return metrics.dot(F.col(a + self.vector), F.col(b + self.vector))


class MeanScorer:
    """Arithmetic mean of the metric vector; items of lists match from 80 of 100 on the spelling ratio."""

    weights = [1 / len(metrics.METRICS)] * len(metrics.METRICS)
    columns = ["name", "name_emb", "embedding", "desc_emb", "type", "authors", "topics", "brands", "divisions", "mpc_round", "forecast_round", "date"]

    def __call__(self, a: str, b: str) -> Column:
        return metrics.mean_score(metrics.metric_vector(close=metrics.close_match()))


class WeightedScorer(MeanScorer):
    """Weighted sum of the metric vector over its length."""

    weights = [w / len(metrics.METRICS) for w in metrics.WEIGHTS]

    def __call__(self, a: str, b: str) -> Column:
        return metrics.weighted_score(metrics.metric_vector(close=metrics.close_match()))


class EntityLinkScorer:
    """Overlap of entities and of links."""

    columns = ["entities", "links"]

    def __call__(self, a: str, b: str) -> Column:
        return metrics.entity_link_score(F.col(a + "entities"), F.col(b + "entities"), F.col(a + "links"), F.col(b + "links"))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 5, key: str = "doc_id", body: str = "text", tokens: Callable[[Column], Column] = text.tokens) -> DataFrame:
    """Top documents of query documents by Okapi relevance; each query's own document may win.

    Texts are split once and their words written; one pass counts the documents of each token, and
    queries then meet the documents in blocks, as tokens with weights.  Negative inverse document frequencies count as NEGATIVE_IDF_SHARE of the
    mean one.  Null texts have no words; documents that share no word with a query aren't ranked.
    """
    words = lambda df: df.select(F.col(key).alias("id"), F.coalesce(tokens(F.col(body)), F.array().cast("array<string>")).alias("s0"))
    rows = materialize(words(docs), "words")
    n, avgdl = rows.agg(F.count("*"), F.avg(F.size("s0"))).first()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    held = materialize(rows.select(F.explode(F.array_distinct("s0")).alias("token")).groupBy("token").agg(F.count("*").alias("df")).select("token", idf.alias("idf")), "idf")
    floor = NEGATIVE_IDF_SHARE * (held.agg(F.avg("idf")).first()[0] or 0.0)
    terms = words(queries).select("id", F.explode("s0").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf")).join(held, "token")
    term = F.struct("token", (F.col("tf") * F.when(F.col("idf") < 0, floor).otherwise(F.col("idf"))).alias("w"))
    asked = terms.groupBy("id").agg(F.collect_list(term).alias("t")).select("id", F.col("t.token").alias("s0"), F.col("t.w").alias("w0"))
    return sparse_top_k(
        rows, asked, 1, lambda sums, a, b: sums[0], k, gain=lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)), itself=True, weighted=True,
    )


def jaccard_top_k(rows: DataFrame, queries: DataFrame, items: Column, key: str, k: int = 5) -> DataFrame:
    """Rows that share the largest part of their item sets with each query row (itself left out).

    Rows that share no item aren't ranked; null lists are empty.
    """
    sets = lambda df: df.select(F.col(key).alias("id"), F.array_distinct(items).alias("s0"))
    return sparse_top_k(sets(rows), sets(queries), 1, lambda both, a, b: share(both[0], a[0], b[0]), k)


def entity_link_top_k(rows: DataFrame, queries: DataFrame, entities: Column, links: Column, key: str, k: int = 5) -> DataFrame:
    """Rows with the best entity and link score for each query row (itself left out).

    Only rows that share an entity or a link with the query score above 0, and are ranked; null
    lists are empty.
    """
    sets = lambda df: df.select(F.col(key).alias("id"), F.array_distinct(entities).alias("s0"), F.array_distinct(links).alias("s1"))
    score = lambda both, a, b: 0.8 * share(both[0], a[0], b[0]) + 0.2 * share(both[1], a[1], b[1])
    return sparse_top_k(sets(rows), sets(queries), 2, score, k)


def robust_scale(edges: DataFrame, weight: str = "weight", by: list[str] | None = None, out: str = "scaled") -> DataFrame:
    """``(w - median) / (q75 - q25)`` with exact interpolated percentiles, per ``by``; no spread counts as 1.

    Null weights stay null and don't count; rows with a null key are left out.
    """
    stats = percentiles(edges, weight, [0.25, 0.5, 0.75], by).withColumnsRenamed({"n": "_n", "q": "_q"})
    joined = join_groups(edges, materialize(stats, "quartiles"), by, "_n") if by else edges.crossJoin(F.broadcast(stats.drop("_n")))
    spread = F.col("_q")[2] - F.col("_q")[0]
    return joined.withColumn(out, (F.col(weight) - F.col("_q")[1]) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)).drop("_q")


def principal_score(vectors: DataFrame, columns: list[str], k: int = 3, out: str = "weight") -> DataFrame:
    """Mean of the first ``k`` principal components of metric columns.

    The covariance matrix (columns squared) comes from one aggregation; each axis points to where
    its largest loading is positive.
    """
    n = len(columns)
    k = min(k, n)
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    aggs += [F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    got = vectors.agg(*aggs).first()
    mean = [got[f"m{i}"] or 0.0 for i in range(n)]
    cov = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])
    load = axes.mean(axis=1)
    terms = [(F.col(c) - mean[i]) * float(load[i]) for i, c in enumerate(columns)]
    return vectors.withColumn(out, sum(terms[1:], terms[0]))


def best_match(names: DataFrame, candidates: DataFrame, name: str, candidate: str, min_score: float = 0.0, block_rows: int = 1024) -> DataFrame:
    """Each name's best candidate by spelling (over ``min_score``); ties go to the shorter, then smaller one.

    Names and candidates meet in an index of their bigrams, from high scores down (``fuzzy.best_names``); names
    that nothing there settles meet all candidates in blocks of about ``block_rows``;
    every distinct name is matched once.  A null name has no match; null candidates take no part.
    """
    left = materialize(names.select(F.col(name).alias("name")).distinct().withColumn("_x", text.squeeze(F.col("name"))), "names")
    right = candidates.where(F.col(candidate).isNotNull()).select(F.col(candidate).alias("match")).distinct().withColumn("_y", text.squeeze(F.col("match")))
    best = fuzzy.best_names(left.where("name is not null"), materialize(right, "candidates"), min_score, block_rows=block_rows)
    return left.select("name").join(best, "name", "left").select("name", F.coalesce("match", F.lit("")).alias("match"), F.coalesce("score", F.lit(-1.0)).alias("score"))
