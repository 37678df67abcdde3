"""Embedding whitening: blockwise QR of centred rows, then one-sided Jacobi on the triangle.

Rows are centred before anything is multiplied, from exact integer sums.  Every task reduces its
rows to triangles (``R`` of a QR decomposition, d x d), triangles are stacked and reduced again in
rounds, and the last one has the same singular values and right vectors as all rows.  Plane
rotations make its columns orthogonal: their lengths are the standard deviations, to nearly full
relative precision, as the covariance is never formed.

The driver holds d sums and one d x d triangle, which depend on the dimensions, not on the rows.

Odd input: rows whose vector is null, or holds a null, NaN or infinite entry, are dropped, and so
are rows that don't have the table's usual number of dimensions (the most frequent one; of equally
frequent ones the greatest) and rows with entries of 2^46 or more, whose grid value isn't exact.
Repeated rows count as often as they occur; a null key stays null; an empty table gives no rows;
other columns are ignored, whatever their names.  A component without variance (rank below the
dimensions, or a single row) has null ``whitened`` values and is left out of ``identity_error``; a
``deviation`` beyond 64 bits is null.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
GRID, SHIFT = 64, 1_000_000
#: Triangles stacked at a time.
FAN_IN = 16
#: Numbers of rows reduced at a time, so that a task's memory doesn't depend on its rows.
BLOCK_NUMBERS = 1 << 21
_MOST = float(1 << 46)


class Sums(NamedTuple):
    """Rows, and the sums of their grid values less SHIFT, by dimension."""

    n: int
    total: np.ndarray


class Components(NamedTuple):
    """Unit vectors (columns, by falling variance), standard deviations, share of variance, and which have any."""

    vectors: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    proper: np.ndarray


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid values less SHIFT of the sound rows of a list column (flat), their places and lengths."""
    lists = column.cast(pa.large_list(pa.float64()))
    flat = lists.flatten()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    bad = ~(np.abs(values) < _MOST)
    row = np.repeat(np.arange(len(lists)), lengths)
    sound = lists.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[bad], minlength=len(lists)) == 0)
    keep = sound[row]
    return np.floor(GRID * values[keep]).astype(np.int64), np.flatnonzero(sound), lengths[sound]


def _rows_of(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The sound rows with ``dims`` entries as a matrix, and their places."""
    flat, at, lengths = _matrix(column)
    fits = lengths == dims
    return flat[np.repeat(fits, lengths)].reshape(-1, dims), at[fits]


def _blocks(matrix: np.ndarray):
    step = max(1, BLOCK_NUMBERS // max(1, matrix.shape[1]))
    for i in range(0, len(matrix), step):
        yield matrix[i : i + step]


def fit_sums(vectors: DataFrame, vector: str = "embedding") -> Sums:
    """Row count and exact sums over all sound rows of the usual length; one pass, one row a length to the driver per task."""

    def scan(batches):
        have: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            flat, _, lengths = _matrix(batch.column(0))
            for dims in np.unique(lengths).tolist():
                m = flat[np.repeat(lengths == dims, lengths)].reshape(-1, dims) if dims else np.zeros((int((lengths == 0).sum()), 0), np.int64)
                n, s = have.get(dims, (0, np.zeros(dims, np.int64)))
                have[dims] = (n + len(m), s + m.sum(axis=0))
        for dims, (n, s) in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.int64()))], names=["dims", "n", "s"])

    parts = vectors.select(vector).mapInArrow(scan, "dims int, n long, s array<long>")
    usual = parts.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if usual is None:
        return Sums(0, np.zeros(0, np.int64))
    sums = parts.where(F.col("dims") == usual["dims"]).select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return Sums(usual["n"], np.array([r["v"] for r in sums], np.int64))


def _centred(m: np.ndarray, sums: Sums) -> np.ndarray:
    """Rows less the mean: the numerators are exact integers, so each entry is rounded once."""
    return (m * sums.n - sums.total).astype(np.float64) / sums.n


def triangle(vectors: DataFrame, sums: Sums, vector: str = "embedding") -> np.ndarray:
    """``R`` of all centred rows, by a tree of QR decompositions; FAN_IN triangles meet in a task."""
    dims = len(sums.total)

    def reduce(r: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, more]), mode="r")

    def scan(batches):
        r = np.zeros((0, dims))
        for batch in batches:
            for m in _blocks(_rows_of(batch.column(0), dims)[0]):
                r = reduce(r, _centred(m, sums))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["r"])

    def stack(part: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, dims))
        for flat in part["r"]:
            r = reduce(r, np.asarray(flat, np.float64).reshape(-1, dims))
        return pd.DataFrame({"p": [int(part["p"].iloc[0])], "r": [r.ravel()]})

    found = vectors.select(vector).mapInArrow(scan, "r array<double>").withColumn("p", F.spark_partition_id())
    left = found.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        found = found.withColumn("p", F.floor(F.col("p") / FAN_IN).cast("int")).groupBy("p").applyInPandas(stack, "p int, r array<double>")
    rows = found.select("r").collect()
    r = np.zeros((0, dims))
    for row in rows:
        r = reduce(r, np.array(row["r"]).reshape(-1, dims))
    return np.vstack([r, np.zeros((dims - len(r), dims))]) if len(r) < dims else r


def jacobi_svd(r: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right vectors (columns) of ``r``: plane rotations until all columns are orthogonal.

    A round rotates disjoint pairs of columns at once; the rounds of a sweep meet every pair (a
    round-robin schedule).  Ends when a sweep finds no pair with a cosine over ``tolerance``.
    """
    d = r.shape[1]
    a, v = r.copy(), np.eye(d)
    players = np.arange(d + d % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(players) - 1):
            p, q = players[: len(players) // 2], players[len(players) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            norm = np.sqrt(xx) * np.sqrt(yy)
            turn = np.abs(xy) > tolerance * norm
            if turn.any():
                worst = max(worst, float((np.abs(xy[turn]) / norm[turn]).max()))
                p, q = p[turn], q[turn]
                z = (yy[turn] - xx[turn]) / (2 * xy[turn])
                t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.sqrt(1 + z * z))
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if worst <= 4 * tolerance * max(d, 1):
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def fit_components(vectors: DataFrame, sums: Sums, vector: str = "embedding", k: int = COMPONENTS) -> Components:
    sigma, v = jacobi_svd(triangle(vectors, sums, vector))
    e = (sigma / np.sqrt(sums.n)) ** 2
    total = e.sum()
    share = e / total if total > 0 else np.zeros_like(e)
    noise = sigma[:1].max(initial=0.0) * max(len(sigma), 1) * np.finfo(np.float64).eps
    k = min(k, len(sigma))
    return Components(v[:, :k], np.sqrt(e[:k]), share[:k], sigma[:k] > noise)


def _whiten(m: np.ndarray, sums: Sums, c: Components) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(c.proper, _centred(m, sums) @ c.vectors / c.deviations, np.nan)


def identity_error(vectors: DataFrame, sums: Sums, c: Components, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, over all rows."""
    dims, proper = len(sums.total), np.flatnonzero(c.proper)
    k = len(proper)
    if not k:
        return None

    def scan(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for m in _blocks(_rows_of(batch.column(0), dims)[0]):
                w = _whiten(m, sums, c)[:, proper]
                first += w.sum(axis=0)
                second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()]).tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = vectors.select(vector).mapInArrow(scan, "s array<double>").select(F.posexplode("s").alias("i", "v"))
    flat = np.array([r["v"] for r in parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()]) / sums.n
    mean, square = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(m: np.ndarray, sums: Sums) -> pa.Array:
    """Exact sums of squares; numbers that may pass 64 bits are added as Python integers."""
    x = m * sums.n - sums.total
    rough = (x.astype(np.float64) ** 2).sum(axis=1)
    exact = (x * x).sum(axis=1).tolist()
    for i in np.flatnonzero(rough > 2.0**62):
        value = sum(int(v) ** 2 for v in x[i])
        exact[i] = value if value < 1 << 63 else None
    return pa.array(exact, pa.int64())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` of every sound row and its first ``k`` components."""
    key_type = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("_v"))
    sums = fit_sums(rows, "_v")
    dims = len(sums.total)
    if not sums.n or not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    largest = int(np.abs(sums.total).max()) + sums.n
    if largest >= 1 << 62:
        raise ValueError("the sums of the grid values pass 64 bits")
    c = fit_components(rows, sums, "_v", k)
    error, k = identity_error(rows, sums, c, "_v"), c.vectors.shape[1]

    def scan(batches):
        for batch in batches:
            everything, places = _rows_of(batch.column(1), dims)
            keys = batch.column(0).take(pa.array(places))
            done = 0
            for m in _blocks(everything):
                n = len(m)
                w = _whiten(m, sums, c).ravel()
                one = pa.array(np.repeat(np.arange(n), k))
                columns = [
                    keys.slice(done, n).take(one), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, sums.n)), _deviation(m, sums).take(one),
                    pa.array(w, pa.float64(), mask=np.isnan(w)), pa.array(np.tile(c.explained, n)), pa.array([error] * (n * k), pa.float64()),
                ]
                done += n
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(scan, schema)
