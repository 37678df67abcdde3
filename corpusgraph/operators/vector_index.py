"""A written index of vectors that answers top-k and threshold searches exactly.

Rows go to the nearest of some centroids and, within a cell, in order of their distance to it, into
blocks of bounded size; a block is one row that holds its ids and its matrix.  Beside the blocks lie
the centroids.  For any row x of a block and any query q, by Cauchy and Schwarz,

    q.x = q.c + q.(x - c) <= q.c + |q| r

with the block's centroid c and largest distance r.  A search first looks into each query's most
promising blocks, which gives it a k-th best score so far, and then into all blocks whose bound
reaches that score; the others can't hold an answer.  Pairs of blocks are bounded alike.

Centroids are fitted on a sample of at most SAMPLE rows; every row is indexed, and answers don't
depend on the sample, only the number of blocks that are skipped does.  What travels to the tasks is
at most MAX_CELLS centroids and four numbers a block, of which there are at most about MAX_BLOCKS
and MAX_CELLS more.

Rows and queries with a null id or vector, or entries that aren't finite, take no part; vectors must
be of one length; repeated rows stay; an empty table makes an empty index.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators.search import Best, half_up, top_k
from corpusgraph.plans.positions import global_positions
from corpusgraph.plans.scratch import materialize, scratch_path

SAMPLE, ROUNDS = 1 << 14, 6
MAX_CELLS, MAX_BLOCKS = 4096, 1 << 20
BLOCK_ROWS, QUERY_ROWS = 256, 1024
DIGITS = 6
#: Groups of blocks, and of queries, that meet: this many, or more where one would hold over GROUP_ROWS rows.
GROUPS, GROUP_ROWS = 12, 1 << 15
_EDGE = 2 * 10.0**-DIGITS
_CELLS = 1 << 22


class Directory(NamedTuple):
    """Centroids (a row each), and per block its number, cell, largest distance and rows."""

    centroids: np.ndarray
    block: np.ndarray
    cell: np.ndarray
    radius: np.ndarray
    rows: np.ndarray


def _clean(df: DataFrame, seq: str, vector: str) -> DataFrame:
    out = df.select(F.col(seq).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return out.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of the sample by a few rounds of k-means from evenly spaced rows."""
    c = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = ((c * c).sum(1) / 2 - sample @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def build(vectors: DataFrame, path: str | None = None, seq: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> str:
    """Write an index of all rows under ``path`` (a new scratch folder by default); returns the path."""
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "vector-index")
    rows = materialize(_clean(vectors, seq, vector), "vectors")
    n = rows.count()
    block_rows = max(block_rows, -(-n // MAX_BLOCKS))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    c = _fit(_matrix(drawn["v"]), min(MAX_CELLS, max(1, n // block_rows))) if n else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(c)

    def place(batches):
        c = shared.value
        for batch in batches:
            m = _matrix(batch.column(1))
            near = np.concatenate([((c * c).sum(1) / 2 - m[i : i + 1024] @ c.T).argmin(axis=1) for i in range(0, len(m), 1024)]) if len(m) else np.zeros(0, np.int64)
            far = np.sqrt(((m - c[near]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(far)], names=["id", "v", "cell", "far"])

    placed, _ = global_positions(rows.mapInArrow(place, "id long, v array<double>, cell int, far double"), ["cell", "far", "id"], F.lit(1), "at", "vector-places")
    item = F.struct("id", "v", "far")
    blocks = placed.groupBy("cell", F.floor(F.col("at") / block_rows).alias("nth")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    blocks = blocks.select(
        (F.col("nth") * (MAX_CELLS + 1) + F.col("cell")).alias("block"), "cell", F.array_max("x.far").alias("radius"), F.size("x").cast("long").alias("n"), F.col("x.id").alias("ids"), F.flatten("x.v").alias("v"),
    )
    blocks.write.parquet(f"{path}/blocks")
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "cell int, centroid array<double>").write.parquet(f"{path}/cells")
    return path


def directory(spark: SparkSession, path: str) -> Directory:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    b = spark.read.parquet(f"{path}/blocks").select("block", "cell", "radius", "n").orderBy("block").toArrow()
    return Directory(_matrix(cells["centroid"]) if cells.num_rows else np.zeros((0, 0)), *(b[x].to_numpy() for x in ("block", "cell", "radius", "n")))


def _picks(asked: DataFrame, shared, k: int, floors: bool) -> DataFrame:
    """``(block, id, v, floor)``: the blocks that each query looks into.

    Without ``floors`` the most promising ones, up to ``k`` rows; with them all others that reach the
    query's floor.
    """

    def scan(batches):
        d: Directory = shared.value
        step = max(1, _CELLS // max(1, len(d.block)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                if not len(d.block):
                    return
                q = _matrix(part.column(1))
                bound = (q @ d.centroids.T)[:, d.cell] + np.sqrt((q * q).sum(1))[:, None] * d.radius
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(d.rows[order], axis=1)
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, held - d.rows[order] < k, axis=1)
                chosen = first
                if floors:
                    floor = part.column(2).to_numpy(zero_copy_only=False)
                    chosen = ~first & (bound >= floor[:, None] - _EDGE)
                at, b = np.nonzero(chosen)
                for lo in range(0, len(at), 4096):
                    take = pa.array(at[lo : lo + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(d.block[b[lo : lo + 4096]]), *[c.take(take) for c in part.columns]], names=["block", "id", "v", "floor"])

    return asked.mapInArrow(scan, "block long, id long, v array<double>, floor double")


def _looked_up(blocks: DataFrame, picks: DataFrame, k: int, itself: bool) -> DataFrame:
    """``(query_id, node_id, score)``: each query's ``k`` best rows of each block it looks into.

    Queries of a block meet it in groups of about QUERY_ROWS, which are spread, as are the copies of the
    block, so that a block that all queries look into is no single task's.
    """
    groups = picks.groupBy("block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
    groups = materialize(groups, "block-groups")
    dealt = picks.join(groups, "block").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    asked = dealt.groupBy("block", "group").agg(F.collect_list(F.struct("id", "v", "floor")).alias("q")).select("block", "group", F.col("q.id").alias("qid"), F.flatten("q.v").alias("qv"), F.col("q.floor").alias("floor"))
    copies = blocks.join(groups, "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    met = copies.join(asked, ["block", "group"]).select("ids", F.col("v").alias("bv"), "qid", "qv", "floor")

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, bv, qid, qv, floor = (c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns)
                score = half_up(qv.reshape(len(qid), -1) @ bv.reshape(len(ids), -1).T, DIGITS)
                keep = score >= floor[:, None]
                if not itself:
                    keep &= qid[:, None] != ids[None, :]
                at, row = np.nonzero(keep)
                best = Best(len(qid), k)
                best.add(at, ids[row], score[at, row])
                yield best.batch(qid)

    return met.mapInArrow(scan, "query_id long, node_id long, score double")


def index_top_k(path: str, queries: DataFrame, k: int = 5, seq: str = "vec_id", vector: str = "embedding", itself: bool = True) -> DataFrame:
    """``(query_id, node_id, score, rank)``: the ``k`` best rows of the index for each query row, exactly.

    Scores are rounded to DIGITS places; ties go to the smaller node.
    """
    spark = queries.sparkSession
    blocks = spark.read.parquet(f"{path}/blocks")
    shared = spark.sparkContext.broadcast(directory(spark, path))
    enough = k if itself else k + 1
    asked = materialize(_clean(queries, seq, vector).withColumn("floor", F.lit(float("-inf"))), "asked")
    first = materialize(top_k(_looked_up(blocks, _picks(asked, shared, enough, False), k, itself), k), "first-look")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("f"))
    again = asked.join(floors.distinct(), "id", "left").select("id", "v", F.coalesce("f", "floor").alias("floor"))
    return top_k(_rest(blocks, again, shared, k, itself), k)


def _groups(rows: int, least: int) -> int:
    return max(1, min(-(-rows // least), max(GROUPS, -(-rows // GROUP_ROWS))))


def _grouped(blocks: DataFrame, d: Directory) -> tuple[DataFrame, int]:
    """Blocks in order of their cell, in groups that travel as one row ``(g, block, cell, radius, n, ids, v)``; how many groups."""
    order = np.lexsort((d.block, d.cell))
    rows = d.rows[order]
    many = _groups(int(rows.sum()), BLOCK_ROWS)
    g = (np.cumsum(rows) - rows) * many // max(1, int(rows.sum()))
    at = blocks.sparkSession.createDataFrame(pa.table({"block": pa.array(d.block[order], pa.int64()), "g": pa.array(g, pa.int32())}))
    packed = blocks.join(at, "block").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("block", "cell", "radius", "ids", "v"))).alias("r"))
    packed = packed.select("g", *[F.col(f"r.{c}").alias(c) for c in ("block", "cell", "radius")], F.transform("r.ids", F.size).alias("n"), F.flatten("r.ids").alias("ids"), F.flatten("r.v").alias("v"))
    return materialize(packed, "block-rows"), many


def _numbers(x: pa.Scalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False)


def _rest(blocks: DataFrame, asked: DataFrame, shared, k: int, itself: bool) -> DataFrame:
    """``(query_id, node_id, score)``: each query's ``k`` best rows of each group of blocks, of those that reach its ``floor``.

    A group of queries meets each group of blocks, so a query travels a bounded number of times, however
    many blocks it looks into; blocks whose bound is under the query's k-th best so far are skipped there.
    """
    many = _groups(asked.count(), QUERY_ROWS)
    held, groups = _grouped(blocks, shared.value)
    dealt = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias("part")).agg(F.collect_list(F.struct("id", "v", "floor")).alias("q"))
    dealt = dealt.select("part", F.col("q.id").alias("qid"), F.flatten("q.v").alias("qv"), F.col("q.floor").alias("floor"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    copies = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    met = dealt.join(copies.hint("shuffle_hash"), ["part", "g"]).select("qid", "qv", "floor", "cell", "radius", "n", "ids", "v")

    def scan(batches):
        centroids = shared.value.centroids
        for batch in batches:
            for i in range(batch.num_rows):
                qid, qv, floor, cell, radius, n, ids, v = (_numbers(c[i]) for c in batch.columns)
                q, m = qv.reshape(len(qid), -1), v.reshape(len(ids), -1)
                norm, end = np.sqrt((q * q).sum(1)), np.cumsum(n)
                best = Best(len(qid), k)
                best.floor = floor.copy()
                for j in range(len(n)):
                    look = np.flatnonzero(q @ centroids[cell[j]] + norm * radius[j] >= best.floor - _EDGE)
                    rows = slice(end[j] - n[j], end[j])
                    step = max(1, _CELLS // max(1, int(n[j])))
                    for lo in range(0, len(look), step):
                        some = look[lo : lo + step]
                        w = q[some] @ m[rows].T
                        at, row = np.nonzero(w >= (best.floor[some] - _EDGE)[:, None])
                        score = half_up(w[at, row], DIGITS)
                        at, row = some[at], ids[rows][row]
                        keep = score >= best.floor[at]
                        if not itself:
                            keep &= qid[at] != row
                        best.add(at[keep], row[keep], score[keep])
                yield best.batch(qid)

    return met.mapInArrow(scan, "query_id long, node_id long, score double")


def index_pairs(path: str, spark: SparkSession, threshold: float) -> DataFrame:
    """``(src, dst, weight)``: all pairs of rows of the index with a product over ``threshold`` (strictly, as rounded).

    Groups of blocks meet, each pair once; there only pairs of blocks whose bound reaches the threshold are multiplied.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    shared = spark.sparkContext.broadcast(directory(spark, path))
    held, groups = _grouped(blocks, shared.value)
    names = ["block", "cell", "radius", "n", "ids", "v"]
    left = held.select(F.col("g").alias("x"), F.explode(F.sequence(F.col("g"), F.lit(groups - 1))).alias("y"), *[F.col(c).alias("a_" + c) for c in names])
    right = held.select(F.explode(F.sequence(F.lit(0), F.col("g"))).alias("x"), F.col("g").alias("y"), *[F.col(c).alias("b_" + c) for c in names])
    both = left.join(right.hint("shuffle_hash"), ["x", "y"]).select("x", "y", *["a_" + c for c in names], *["b_" + c for c in names])

    def scan(batches):
        centroids = shared.value.centroids
        norm = np.sqrt((centroids**2).sum(axis=1))
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(0)[i] == batch.column(1)[i]
                xb, xc, xr, xn, x, xv, yb, yc, yr, yn, y, yv = (_numbers(c[i]) for c in batch.columns[2:])
                xv, yv, to, till = xv.reshape(len(x), -1), yv.reshape(len(y), -1), np.cumsum(xn), np.cumsum(yn)
                for a in range(len(xb)):
                    ids, m = x[to[a] - xn[a] : to[a]], xv[to[a] - xn[a] : to[a]]
                    bound = centroids[yc] @ centroids[xc[a]] + norm[xc[a]] * yr + norm[yc] * xr[a] + xr[a] * yr
                    for b in np.flatnonzero((bound > threshold - _EDGE) & (not same or yb >= xb[a])):
                        rows = slice(till[b] - yn[b], till[b])
                        w = m @ yv[rows].T
                        p, q = np.nonzero(w > threshold - _EDGE)
                        w, s, t = half_up(w[p, q], DIGITS), ids[p], y[rows][q]
                        keep = (w > threshold) & (s < t if xb[a] == yb[b] else s != t)
                        s, t = s[keep], t[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, t)), pa.array(np.maximum(s, t)), pa.array(w[keep])], names=["src", "dst", "weight"])

    return both.mapInArrow(scan, "src long, dst long, weight double")


def block_pairs(blocks: DataFrame, shared, threshold: float) -> DataFrame:
    """``(a, b)``, ``a <= b``: the pairs of blocks that may hold a product over ``threshold``."""

    def scan(batches):
        d: Directory = shared.value
        norm = np.sqrt((d.centroids**2).sum(axis=1))
        for batch in batches:
            for a, cell, r in zip(*(c.to_numpy() for c in batch.columns), strict=True):
                bound = (d.centroids @ d.centroids[cell])[d.cell] + norm[cell] * d.radius + norm[d.cell] * r + r * d.radius
                b = d.block[(bound > threshold - _EDGE) & (d.block >= a)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a)), pa.array(b)], names=["a", "b"])

    return blocks.select("block", "cell", "radius").mapInArrow(scan, "a long, b long")


def looks(path: str, queries: DataFrame, k: int = 5, seq: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: queries, blocks, and how many (query, block) pairs a top-k search looks into."""
    spark = queries.sparkSession
    d = directory(spark, path)
    shared = spark.sparkContext.broadcast(d)
    best = index_top_k(path, queries, k, seq, vector).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("f"))
    asked = _clean(queries, seq, vector).join(best.distinct(), "id", "left").select("id", "v", F.coalesce("f", F.lit(float("-inf"))).alias("floor"))
    n = _picks(asked, shared, k, False).count() + _picks(asked, shared, k, True).count()
    return spark.createDataFrame([(asked.count(), len(d.block), n)], "queries long, blocks long, looked long")
