"""Pairs of nodes: blocked all-pairs scores and top-k searches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.metrics import dot
from corpusgraph.operators.search import Best, half_up, search

BLOCK_ROWS = 1024


def chunks(nodes: DataFrame, n: int, seq: str) -> DataFrame:
    """Stripe rows over ``n`` chunks by position (position mod n)."""
    return nodes.withColumn("chunk", F.pmod(F.col(seq), F.lit(n)))


def all_pairs(nodes: DataFrame, seq: str = "vec_id", vector: str = "embedding", metric: str = "dot", min_weight: float | None = None, both_ways: bool = False, digits: int | None = 6, reduce: tuple[Callable[[np.ndarray], pa.Table], str] | None = None) -> DataFrame:
    """``(src, dst, weight)`` of all pairs with ``src < dst`` (or all ordered pairs).

    Vectors are striped into blocks of about BLOCK_ROWS; each pair of blocks is one matrix product
    of bounded size.  ``min_weight`` (strict) is applied inside the block, so that a sparse graph
    never writes its complement.  ``reduce`` (a function of a block's rounded weights, and its
    schema) replaces the pairs by what it returns, so that none leaves its block.  Rows with a null vector or position take no part.
    """
    rows = nodes.select(F.col(seq).cast("long").alias("seq"), F.col(vector).cast("array<double>").alias("v")).where("seq is not null and v is not null")
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    mine = F.pmod(F.xxhash64("seq"), F.lit(n)).cast("int")
    sides = rows.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keyed = sides.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "seq", "v")

    def score(table: pa.Table) -> pa.Table:
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        block, ids = table["block"].to_numpy(), table["seq"].to_numpy()
        m = np.array(table["v"].to_pylist(), dtype=float).reshape(len(ids), -1)
        if metric == "cosine":
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)
        left, right = block == x, block == y
        w = m[left] @ m[right].T
        a, b = np.meshgrid(ids[left], ids[right], indexing="ij")
        keep = a < b if x == y else a != b
        if min_weight is not None:  # what rounding may lift over it is decided on the rounded weights
            keep &= w > min_weight - (10.0**-digits if digits is not None else 0.0)
        a, b, w = a[keep], b[keep], w[keep]
        if reduce is not None:
            return reduce[0](np.copysign(half_up(np.abs(w), digits), w) if digits is not None else w)
        low, high = np.minimum(a, b), np.maximum(a, b)
        if both_ways:
            low, high, w = np.concatenate([low, high]), np.concatenate([high, low]), np.concatenate([w, w])
        return pa.table({"src": low, "dst": high, "weight": w})

    out = keyed.groupBy("x", "y").applyInArrow(score, reduce[1] if reduce else "src long, dst long, weight double")
    if reduce is not None:
        return out
    if digits is not None:
        out = out.withColumn("weight", F.round("weight", digits))
    return out if min_weight is None else out.where(F.col("weight") > min_weight)


def theta_pairs(nodes: DataFrame, seq: str, score: Callable[[str, str], Column], columns: list[str], out: str = "weight") -> DataFrame:
    """All pairs ``a_seq < b_seq`` with any column score over prefixed columns (quadratic by nature)."""
    a = nodes.select(*[F.col(c).alias("a_" + c) for c in dict.fromkeys([seq, *columns])])
    b = nodes.select(*[F.col(c).alias("b_" + c) for c in dict.fromkeys([seq, *columns])])
    return a.join(b, F.col("a_" + seq) < F.col("b_" + seq)).withColumn(out, score("a_", "b_"))


def vector_top_k(nodes: DataFrame, queries: DataFrame, k: int = 5, seq: str = "vec_id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """``(query_id, node_id, score, rank)``: each query's ``k`` nearest nodes by dot product.

    Rows with a null vector or id take no part; vectors must be of one length.
    """
    clean = lambda df: df.select(F.col(seq).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    matrix = lambda lists: lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)

    def scan(batches, block, k):
        ids, q = block
        best = Best(len(ids), k)
        for batch in batches:
            node = batch.column(0).to_numpy()
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                score = np.round(q @ matrix(batch.column(1).slice(i, BLOCK_ROWS)).T, 6)
                at, row = np.nonzero(score >= best.floor[:, None])
                best.add(at, node[i:][row], score[at, row])
        yield best.batch(ids)

    load = lambda t: (t["id"].to_numpy(), matrix(t["v"].combine_chunks()))
    return search(clean(nodes), clean(queries), F.lit(1), block_rows, load, scan, k)


def every_other_edge(edges: DataFrame, seq: str = "src") -> DataFrame:
    """Edges from even positions to the next one."""
    return edges.where((F.col(seq) % 2 == 0) & (F.col("dst") == F.col(seq) + 1))


def next_pairs(nodes: DataFrame, seq: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """``every_other_edge`` of all pairs by dot product, by a join: no other pair is made."""
    side = lambda c, v: nodes.select(F.col(seq).cast("long").alias(c), F.col(vector).alias(v)).where(f"{c} is not null and {v} is not null")
    met = side("src", "a").where("src % 2 = 0").join(side("dst", "b"), F.col("src") + 1 == F.col("dst"))
    return met.select("src", "dst", F.round(dot(F.col("a"), F.col("b")), digits).alias("weight"))
