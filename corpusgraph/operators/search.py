"""Searches of a query set against all rows, in blocks of bounded size.

A block of queries travels to the rows, one block at a time; each task keeps its own k best rows of
every query, so that what is shuffled is k rows per query and partition, however common an item is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.operators.composite import likely_pairs
from corpusgraph.plans.scratch import materialize

#: A block holds queries of about this many items in all, each query counted as MIN_ITEMS or more.
BLOCK_ITEMS, MIN_ITEMS = 1 << 20, 512
_CELLS = 1 << 22
#: Sets meet in products of up to TILE_ROWS rows and TILE_QUERIES queries, so a block of them may hold more items.
SET_ITEMS, TILE_ROWS, FIRST_ROWS, TILE_QUERIES = 1 << 22, 1024, 32, 2048
#: Items that this share of a block's queries (and so many queries) hold are columns of the products, up to so many; others are looked up.
COMMON_SHARE, COMMON_LEAST, COMMON_MOST = 1 / 24, 8, 2048
FOUND = "query_id long, node_id long, score double"


def top_k(scored: DataFrame, k: int, query: str = "query_id", score: str = "score", tie: str = "node_id") -> DataFrame:
    """The ``k`` best rows of every query with their rank; ties go to the smaller node."""
    order = Window.partitionBy(query).orderBy(F.desc_nulls_last(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


class Best:
    """The ``k`` best rows of each query (higher score, then smaller node), fed in slices."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.floor = k, np.full(n_queries, -np.inf)
        self.query, self.node, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, node: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.floor[query]
        q, n, s = (np.concatenate([old, new[keep]]) for old, new in ((self.query, query), (self.node, node), (self.score, score)))
        order = np.lexsort((n, -s, q))
        q, n, s = q[order], n[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.floor[q[place == self.k - 1]] = s[place == self.k - 1]
        keep = place < self.k
        self.query, self.node, self.score = q[keep], n[keep], s[keep]

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[self.query]), pa.array(self.node), pa.array(self.score)], names=["query_id", "node_id", "score"])


def search(rows: DataFrame, asked: DataFrame, size: Column, limit: int, load: Callable[[pa.Table], object], scan: Callable[[Iterator, object, int], Iterator], k: int, write: bool = False) -> DataFrame:
    """``(query_id, node_id, score, rank)`` of ``scan(batches, block, k)`` over ``rows``.

    ``asked`` has an ``id``; its rows are dealt into blocks whose ``size`` is about ``limit`` in all,
    and ``load`` turns a block into what is broadcast.  With several blocks the found rows of each
    are written, and the block is gone before the next one comes.  ``write``: so are the rows first, which
    each block then reads.  No queries: no rows.
    """
    spark = rows.sparkSession
    asked = materialize(asked, "queries")
    n = int(asked.agg(F.sum(size)).first()[0] or 0) // limit + 1
    rows = materialize(rows, "rows") if write and n > 1 else rows
    paths = []
    for i in range(n):
        got = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i)).toArrow()
        if not got.num_rows:
            continue
        shared = spark.sparkContext.broadcast(load(got))

        def task(batches, shared=shared):
            yield from scan(batches, shared.value, k)

        found = rows.mapInArrow(task, FOUND)
        if n == 1:
            return top_k(found, k)
        paths.append(materialize(top_k(found, k), "found")._written_at)
        shared.destroy()
    schema = FOUND + ", rank int"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def scored_top_k(nodes: DataFrame, queries: DataFrame, scorer, seq: str, k: int = 5, block_rows: int = 256) -> DataFrame:
    """``(query_id, node_id, score, rank)``: each query row's best other nodes by any column scorer.

    Queries travel to the nodes ``block_rows`` at a time; the k best of a partition are kept before the
    shuffle.  Of a scorer with ``weights`` of the metric vector only pairs that may be among the best
    are scored (``composite``).  Rows with a null ``seq`` take no part; null scores come last.
    """
    side = lambda df, p: df.where(F.col(seq).isNotNull()).select(*[F.col(c).alias(p + c) for c in dict.fromkeys([seq, *scorer.columns])])
    asked, rows = materialize(side(queries, "a_"), "queries"), side(nodes, "b_")
    n, paths = asked.count() // block_rows + 1, []
    for i in range(n):
        part = asked if n == 1 else asked.where(F.pmod(F.xxhash64("a_" + seq), F.lit(n)) == i)
        if weights := getattr(scorer, "weights", None):
            pairs = likely_pairs(rows, part, seq, weights, k).join(F.broadcast(part), "a_" + seq)
        else:
            pairs = rows.join(F.broadcast(part), F.col("a_" + seq) != F.col("b_" + seq))
        best = top_k(pairs.select(F.col("a_" + seq).alias("query_id"), F.col("b_" + seq).alias("node_id"), F.round(scorer("a_", "b_"), 6).alias("score")), k)
        if n == 1:
            return best
        paths.append(materialize(best, "found"))
    return nodes.sparkSession.read.schema(paths[0].schema).parquet(*[p._written_at for p in paths])


class Tile(NamedTuple):
    """Some queries of a block of sets; of each part, sizes, a matrix of the common items, and who holds each other item."""

    ids: np.ndarray
    sizes: list[np.ndarray]
    common: list[np.ndarray]
    start: list[np.ndarray]
    owner: list[np.ndarray]


class Sets:
    """A block of queries that are sets, dealt into tiles; of each part, its items, of which the first ``common`` are columns."""

    def __init__(self, ids: np.ndarray, parts: list[pa.ListArray]):
        self.items, self.common, coded = [], [], []
        for lists in parts:
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), _lengths(lists))[flat.is_valid().to_numpy(zero_copy_only=False)]
            found = flat.drop_null().dictionary_encode()
            code = found.indices.to_numpy(zero_copy_only=False)
            held = np.bincount(code, minlength=len(found.dictionary))
            order = np.argsort(-held, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            self.items.append(found.dictionary.take(pa.array(order)))
            self.common.append(min(COMMON_MOST, int((held >= max(COMMON_LEAST, COMMON_SHARE * len(ids))).sum())))
            coded.append((owner, place[code], _lengths(lists)))
        self.tiles = [self._tile(ids, coded, lo, min(lo + TILE_QUERIES, len(ids))) for lo in range(0, len(ids), TILE_QUERIES)]

    def _tile(self, ids: np.ndarray, coded: list[tuple], lo: int, hi: int) -> Tile:
        tile = Tile(ids[lo:hi], [], [], [], [])
        for (owner, code, size), common, items in zip(coded, self.common, self.items, strict=True):
            a, b = np.searchsorted(owner, [lo, hi])
            owner, code = owner[a:b] - lo, code[a:b]
            matrix = np.zeros((hi - lo, common), np.uint8)
            matrix[owner[code < common], code[code < common]] = 1
            owner, code = owner[code >= common], code[code >= common] - common
            order = np.argsort(code, kind="stable")
            start = np.zeros(len(items) - common + 1, np.int64)
            np.cumsum(np.bincount(code, minlength=len(items) - common), out=start[1:])
            for held, x in zip(tile[1:], (size[lo:hi], matrix, start, owner[order]), strict=True):
                held.append(x)
        return tile


class Postings:
    """Which queries hold an item, and with which weight."""

    def __init__(self, items: pa.ListArray, weights: pa.ListArray | None):
        flat, length = items.flatten(), _lengths(items)
        owner = np.repeat(np.arange(len(items)), length)
        weight = np.ones(len(flat)) if weights is None else weights.flatten().to_numpy(zero_copy_only=False)
        valid = flat.is_valid().to_numpy(zero_copy_only=False)
        coded = flat.drop_null().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.items, self.sizes = coded.dictionary, length
        self.owner, self.weight = owner[valid][order], weight[valid][order]
        self.start = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))

    def found(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return _found(lists, self.items)


def _found(lists: pa.ListArray, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and item number of every item of ``lists`` that is one of ``items``, in row order."""
    flat = lists.flatten()
    code = pc.index_in(flat, value_set=items.cast(flat.type), skip_nulls=True)
    row = np.repeat(np.arange(len(lists)), _lengths(lists))
    hit = code.is_valid().to_numpy(zero_copy_only=False)
    return row[hit], code.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def sparse_top_k(
    rows: DataFrame, asked: DataFrame, parts: int, score: Callable[[list[np.ndarray], list[np.ndarray], list[np.ndarray]], np.ndarray], k: int,
    gain: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, itself: bool = False, weighted: bool = False, limit: int | None = None,
) -> DataFrame:
    """``(query_id, node_id, score, rank)``: the rows with the best scores among those that share an item.

    ``rows`` holds ``id`` and lists ``s0, s1, ...`` (``parts`` of them), ``asked`` too (and weights
    ``w0, ...`` if ``weighted``).  ``score(sums, row sizes, query sizes)`` gets, for each part, the
    sum over common items of the query's weight times ``gain(times in the row, row's size)``, as
    matrices of rows by queries.  Without ``gain`` the lists are sets and a common item counts 1; if they have no
    weights either, ``score`` must be above 0 just where an item is common, and rows are compared as matrices (``_compare``).
    Ids are whole numbers; rows and queries with a null id take no part; null lists are empty and
    null items are never common.
    """
    names = [f"s{i}" for i in range(parts)]
    many = sum((F.size(c) for c in names[1:]), F.size(names[0]))

    def load(table: pa.Table) -> tuple:
        lists = [Postings(_whole(table[c]), _whole(table["w" + c[1:]]) if weighted else None) for c in names]
        return _whole(table["id"]).to_numpy(), lists

    def scan(batches, block, k):
        ids, lists = block
        best, n_q = Best(len(ids), k), len(ids)
        for batch in batches:
            node = batch.column(0).to_numpy()
            sizes = [_lengths(batch.column(i + 1)) for i in range(parts)]
            hits, work = [], np.zeros(len(node), np.int64)
            for i, posting in enumerate(lists):
                row, code = posting.found(batch.column(i + 1))
                times = np.ones(len(row), np.int64)
                if gain is not None and len(row):
                    pair, times = np.unique(row * len(posting.items) + code, return_counts=True)
                    row, code = pair // len(posting.items), pair % len(posting.items)
                held = posting.start[code + 1] - posting.start[code]
                np.add.at(work, row, held)
                hits.append((row, code, held, times.astype(float) if gain is None else gain(times, sizes[i][row])))
            done = np.concatenate([[0], np.cumsum(work)])
            i = 0
            while i < len(node):
                j = min(i + max(1, _CELLS // n_q), max(i + 1, int(np.searchsorted(done, done[i] + _CELLS, "right")) - 1))
                if done[j] > done[i]:
                    _slice(best, ids, node[i:j], [s[i:j] for s in sizes], lists, hits, i, j, score, itself)
                i = j
        yield best.batch(ids)

    def load_sets(table: pa.Table) -> Sets:
        return Sets(_whole(table["id"]).to_numpy(), [_whole(table[c]) for c in names])

    def scan_sets(batches, block, k):
        best = [Best(len(t.ids), k) for t in block.tiles]
        common = [[m.astype(np.float32).T for m in t.common] for t in block.tiles]
        step = FIRST_ROWS
        for batch in batches:
            node = batch.column(0).to_numpy()
            sizes = [_lengths(batch.column(i + 1)) for i in range(parts)]
            hits, work = [], np.zeros(len(node), np.int64)
            for i, items in enumerate(block.items):
                row, code = _found(batch.column(i + 1), items)
                often = code < block.common[i]
                rare, code_ = row[~often], code[~often] - block.common[i]
                for t in block.tiles:
                    work += np.bincount(rare, t.start[i][code_ + 1] - t.start[i][code_], len(node)).astype(np.int64)
                hits.append((row[often], code[often], rare, code_))
            done = np.concatenate([[0], np.cumsum(work)])
            i = 0
            while i < len(node):
                # the first rows set a floor that few of the others pass, so products grow
                j = min(len(node), i + step, max(i + 1, int(np.searchsorted(done, done[i] + _CELLS, "right")) - 1))
                step = min(TILE_ROWS, 2 * step)
                rows_ = _columns(hits, block.common, i, j)
                for t, c, b in zip(block.tiles, common, best, strict=True):
                    _compare(b, t, c, node[i:j], [s[i:j] for s in sizes], rows_, score, itself)
                i = j
        for t, b in zip(block.tiles, best, strict=True):
            yield b.batch(t.ids)

    clean = lambda df, more=(): df.select(F.col("id").cast("long").alias("id"), *[F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c) for c in names], *more).where("id is not null")
    size = F.greatest(many, F.lit(MIN_ITEMS))
    if gain is None and not weighted:
        return search(clean(rows), clean(asked), size, limit or SET_ITEMS, load_sets, scan_sets, k, write=True)
    return search(clean(rows), clean(asked, [f"w{i}" for i in range(parts)] if weighted else []), size, limit or BLOCK_ITEMS, load, scan, k)


def _columns(hits: list[tuple], common: list[int], i: int, j: int) -> list[tuple]:
    """Of the rows ``i`` to ``j``, for each part, the matrix of common items, and row and number of each other item."""
    out = []
    for (row, code, rare, other), width in zip(hits, common, strict=True):
        a, b = np.searchsorted(row, [i, j])
        matrix = np.zeros((j - i, width), np.float32)
        matrix[row[a:b] - i, code[a:b]] = 1
        a, b = np.searchsorted(rare, [i, j])
        out.append((matrix, rare[a:b] - i, other[a:b]))
    return out


def _compare(best: Best, tile: Tile, common: list[np.ndarray], node: np.ndarray, sizes: list[np.ndarray], rows: list[tuple], score, itself: bool) -> None:
    """Score some rows against a tile's queries: all roughly, and in full those that may pass the queries' floors."""
    n_q, sums = len(tile.ids), []
    for (matrix, row, code), columns, start, owner in zip(rows, common, tile.start, tile.owner, strict=True):
        both = matrix @ columns
        n = start[code + 1] - start[code]
        at = np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(both.reshape(-1), np.repeat(row * n_q, n) + owner[at], np.float32(1))
        sums.append(both)
    rough = score(sums, [s.astype(np.float32)[:, None] for s in sizes], [s.astype(np.float32)[None, :] for s in tile.sizes])
    # single precision and rounding to six places move a score by less than 2e-6
    r, q = np.divmod(np.flatnonzero(rough > np.maximum(best.floor - 2e-6, 1e-12).astype(np.float32)), n_q)
    if not itself:
        other = node[r] != tile.ids[q]
        r, q = r[other], q[other]
    if len(r):
        best.add(q, node[r], half_up(score([s[r, q].astype(float) for s in sums], [s[r] for s in sizes], [s[q] for s in tile.sizes])))


def _slice(best, ids, node, sizes, lists, hits, i, j, score, itself) -> None:
    """Score the rows ``i`` to ``j`` against all queries of the block."""
    n_q, cells = len(ids), len(node) * len(ids)
    touched, sums = np.zeros(cells, bool), []
    for posting, (row, code, held, weight) in zip(lists, hits, strict=True):
        a, b = np.searchsorted(row, [i, j])
        n = held[a:b]
        at = np.repeat(posting.start[code[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(row[a:b] - i, n) * n_q + posting.owner[at]
        touched[cell] = True
        sums.append(np.bincount(cell, weights=np.repeat(weight[a:b], n) * posting.weight[at], minlength=cells).reshape(-1, n_q))
    touched = touched.reshape(-1, n_q)
    if not itself:
        touched &= node[:, None] != ids[None, :]
    r, q = np.nonzero(touched)
    got = half_up(score([s[r, q] for s in sums], [s[r] for s in sizes], [p.sizes[q] for p in lists]))
    best.add(q, node[r], got)


def share(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common items over all items of two sets; 0 for two empty sets."""
    return both / np.maximum(a + b - both, 1)
