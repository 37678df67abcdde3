"""Bounds of the composite metric scores, so that few pairs of a search are scored in full.

Of the eleven metrics all but the spelling of names are had for whole blocks of pairs at once:
vector products, type and date tables, equal values, and list overlaps through a matrix of items
that are spelled alike.  A name's spelling ratio lies between 0 and what its length and letters
allow.  That gives every pair a range.  One pass finds, for each query, the k-th best lower end; a
second one lets through the pairs whose upper end reaches it, and only these are scored.

Rows that the block arithmetic can't hold (nulls, NaN, vectors of another length, other types) get
the widest range and are scored in full, so results are those of scoring every pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.metrics import DOC_TYPES, METRICS
from corpusgraph.operators.fuzzy import lcs_lengths

VECTORS = ("name_emb", "embedding", "desc_emb")
LISTS = ("authors", "topics", "brands", "divisions")
PLAIN = ("name", "type", "mpc_round", "forecast_round", "date")
#: What rounding to three places may move a metric by, with room to spare.
SLACK = 0.002
LETTERS, CELLS, FAR = 32, 1 << 20, 1e9
CLOSE = 0.8


def needs(prefix: str, seq: str) -> dict[str, Column]:
    """What the bounds need of each row: texts in lower case by Spark, as the scores have them."""
    col = lambda c: F.col(prefix + c)
    out = {"seq": col(seq)} | {c: col(c).cast("array<double>") for c in VECTORS} | {c: col(c) for c in PLAIN}
    for c in LISTS:
        x = F.array_distinct(col(c)) if c == "authors" else col(c)
        out[f"{c}_own"] = F.transform(F.filter(F.array_distinct(x), lambda v: F.trim(v) != ""), lambda v: F.lower(v))
        out[f"{c}_all"] = F.transform(x, lambda v: F.lower(v))
    return out


class Side:
    """The columns of a table of rows as arrays; ``odd`` marks rows with the widest range."""

    def __init__(self, table: pa.Table | pa.RecordBatch, dims: tuple[int, ...] | None = None):
        get = lambda c: self._whole(table.column(c))
        self.n, self.seq = table.num_rows, get("seq")
        self.odd = np.zeros(self.n, bool)
        self.vectors, self.dims = [], []
        for i, c in enumerate(VECTORS):
            m, bad = self._matrix(get(c), dims[i] if dims else None)
            self.vectors.append(m)
            self.dims.append(m.shape[1])
            self.odd |= bad
        self.names = self._strings(get("name"))
        self.types = self._strings(get("type"))
        self.equal = [get("mpc_round"), get("forecast_round")]
        date = get("date")
        known = pa.types.is_date32(date.type) and not date.null_count
        self.days = date.cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64) if known else None
        self.lists = [(self._items(get(f"{c}_own")), self._items(get(f"{c}_all"))) for c in LISTS]
        self.length = np.fromiter(map(len, self.names), np.int64, self.n)
        self.letters = np.zeros((self.n, LETTERS), np.int64)
        for i, name in enumerate(self.names):
            for ch in name:
                self.letters[i, ord(ch) % LETTERS] += 1

    @staticmethod
    def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
        return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

    def _strings(self, column: pa.Array) -> list[str]:
        if not pa.types.is_string(column.type):
            self.odd[:] = True
            return [""] * self.n
        self.odd |= column.is_null().to_numpy(zero_copy_only=False)
        return pc.fill_null(column, "").to_pylist()

    def _matrix(self, column: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
        length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        if dims is None:
            values, counts = np.unique(length[length >= 0], return_counts=True)
            dims = int(values[counts.argmax()]) if len(values) else 0
        fits = length == dims
        m = np.zeros((self.n, dims))
        flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
        if fits.any() and dims:
            m[fits] = flat[np.repeat(fits, np.maximum(length, 0))].reshape(-1, dims)
        bad = ~fits | ~np.isfinite(m).all(axis=1)
        m[bad] = 0
        return m, bad

    def _items(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct items, each place's item number, and each place's row."""
        if not pa.types.is_string(column.type.value_type):
            self.odd[:] = True
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, flat = np.repeat(np.arange(self.n), length), column.flatten()
        empty = flat.is_null().to_numpy(zero_copy_only=False)
        self.odd |= column.is_null().to_numpy(zero_copy_only=False)
        self.odd[row[empty]] = True
        coded = pc.fill_null(flat, "").dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row


def _alike(a: list[str], b: list[str], known: dict[tuple[str, str], bool]) -> np.ndarray:
    """Which items are spelled alike; pairs whose lengths rule it out, or seen before, aren't compared."""
    out = np.zeros((len(a), len(b)), bool)
    ask: list[tuple[int, int]] = []
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    total = la[:, None] + lb[None, :]
    possible = 2 * np.minimum(la[:, None], lb[None, :]) >= CLOSE * total - 1e-9
    for i, j in zip(*np.nonzero(possible), strict=True):
        if (hit := known.get((a[i], b[j]))) is None:
            ask.append((i, j))
        else:
            out[i, j] = hit
    if ask:
        x, y = [a[i] for i, _ in ask], [b[j] for _, j in ask]
        n = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
        hits = np.where(n == 0, 1.0, 2.0 * lcs_lengths(x, y) / np.maximum(n, 1)) * 100 >= 100 * CLOSE
        for (i, j), hit in zip(ask, hits.tolist(), strict=True):
            out[i, j] = hit
            if len(known) < 1 << 20:
                known[a[i], b[j]] = hit
    return out


def _type_scores(a: list[str], b: list[str]) -> np.ndarray:
    ua, ia = np.unique(np.array(a, object), return_inverse=True)
    ub, ib = np.unique(np.array(b, object), return_inverse=True)
    t = np.zeros((len(ua), len(ub)))
    for i, x in enumerate(ua):
        for j, y in enumerate(ub):
            if x == y:
                t[i, j] = 1.0
            elif x in DOC_TYPES:
                t[i, j] = 2 * (DOC_TYPES[x].get(y, 0.5) - 0.5)
            else:
                t[i, j] = 2 * (DOC_TYPES.get(y, {}).get(x, 0.5) - 0.5)
    return t[ia][:, ib]


def ranges(a: Side, b: Side, weights: list[float], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the weighted sums of all pairs of queries ``a`` and rows ``b``."""
    w = dict(zip(METRICS, weights, strict=True))
    mid, spread = np.zeros((a.n, b.n)), np.zeros((a.n, b.n))

    def add(metric: str, low: np.ndarray | float, high: np.ndarray | float) -> None:
        nonlocal mid, spread
        mid += w[metric] * (low + high) / 2
        spread += abs(w[metric]) * ((high - low) / 2 + SLACK)

    dots = [x @ y.T for x, y in zip(a.vectors, b.vectors, strict=True)]
    shared = np.zeros((a.n, b.n), np.int64)
    for i in range(LETTERS):
        shared += np.minimum(a.letters[:, i][:, None], b.letters[:, i][None, :])
    total = a.length[:, None] + b.length[None, :]
    most = np.where(total == 0, 1.0, 2.0 * shared / np.maximum(total, 1))
    add("name", np.where(total == 0, 0.5, -0.5) + 0.5 * dots[0], most - 0.5 + 0.5 * dots[0])
    add("text", dots[1], dots[1])
    add("desc", dots[2], dots[2])
    types = _type_scores(a.types, b.types)
    add("type", types, types)
    for metric, (own, mine), (_, all_) in zip(("author", "topic", "brand", "division"), a.lists, b.lists, strict=True):
        items, item, row = own
        theirs, item_b, row_b = all_
        size_a, size_b = (np.bincount(x[2], minlength=n) for x, n in ((mine, a.n), (all_, b.n)))
        has = np.zeros((b.n, len(items)))
        if len(items) and len(theirs):
            np.add.at(has, row_b, _alike(items, theirs, known).T[item_b].astype(float))
        holds = np.zeros((a.n, len(items)))
        np.add.at(holds, (row, item), 1.0)
        common = holds @ (has > 0).T.astype(float)
        union = size_a[:, None] + size_b[None, :] - common
        score = 2 * np.minimum(1.0, np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)) - 1
        if metric == "brand":
            nan = [np.bincount(r[np.array(d, object)[i] == "nan"], minlength=n) > 0 if len(d) else np.zeros(n, bool) for (d, i, r), n in ((mine, a.n), (all_, b.n))]
            score = np.where(nan[0][:, None] | nan[1][None, :], 0.0, score)
        add(metric, score, score)
    for metric, x, y in zip(("mpc_round", "forecast_round"), a.equal, b.equal, strict=True):
        if x.type != y.type or pa.types.is_floating(x.type) or pa.types.is_nested(x.type):
            add(metric, -1.0, 1.0)
            continue
        values = pc.unique(x)
        place = lambda v: pc.fill_null(pc.index_in(v, value_set=values), -1).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        same = np.where(place(x)[:, None] == place(y)[None, :], 1.0, -1.0)
        add(metric, same, same)
    if a.days is None or b.days is None:
        spread += FAR  # a missing date makes the whole score null
    else:
        diff = a.days[:, None] - b.days[None, :]
        score = np.where((diff < -90) | (diff > 365), -1.0, np.where((diff > -15) & (diff < 15), 1.0, 1 / (0.5 + (diff / 365.0) ** 2) - 1))
        add("date", score, score)
    low, high = mid - spread, mid + spread
    odd = a.odd[:, None] | b.odd[None, :]
    low[odd], high[odd] = -FAR, FAR
    values = pc.unique(a.seq)
    at_a, at_b = (pc.fill_null(pc.index_in(v, value_set=values), -1).to_numpy(zero_copy_only=False) for v in (a.seq, b.seq))
    itself = at_a[:, None] == at_b[None, :]
    low[itself] = high[itself] = -np.inf
    return low, high


def likely_pairs(rows: DataFrame, asked: DataFrame, seq: str, weights: list[float], k: int) -> DataFrame:
    """``rows`` (columns ``b_…``) beside ``a_<seq>`` of each query of ``asked`` (``a_…``, of bounded size) that may be among its ``k`` best.

    The driver holds the block of queries and one number a query.
    """
    block = asked.select(*[c.alias(n) for n, c in needs("a_", seq).items()]).toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(block)
    wanted = needs("b_", seq)
    own = rows.columns
    columns, names = [c.alias(n) for n, c in wanted.items()], list(wanted)

    def slices(batch: pa.RecordBatch, n_q: int):
        step = max(1, CELLS // max(1, n_q))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)

    def lows(batches):
        a, known = Side(shared.value), {}
        best = np.full((a.n, k), -np.inf)
        for batch in batches:
            for part in slices(batch, a.n):
                low, _ = ranges(a, Side(part, tuple(a.dims)), weights, known)
                best = -np.partition(-np.hstack([best, low]), k - 1, axis=1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(a.n), k)), pa.array(best.ravel())], names=["q", "low"])

    found = rows.select(*columns).mapInArrow(lows, "q long, low double")
    kept = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).where(F.col("n") == k)
    floor = np.full(block.num_rows, -np.inf)
    for r in kept.select("q", "low").collect():
        floor[r.q] = r.low

    def through(batches):
        a, known = Side(shared.value), {}
        for batch in batches:
            for part in slices(batch, a.n):
                side = pa.RecordBatch.from_arrays(part.columns[len(own) :], names=names)
                _, high = ranges(a, Side(side, tuple(a.dims)), weights, known)
                q, r = np.nonzero((high >= floor[:, None]) & (high > -np.inf))
                for i in range(0, len(q), 1024):
                    at = pa.array(r[i : i + 1024])
                    yield pa.RecordBatch.from_arrays([a.seq.take(pa.array(q[i : i + 1024])), *[c.take(at) for c in part.columns[: len(own)]]], names=["a_" + seq, *own])

    schema = ", ".join(f"`{n}` {rows.schema[c].dataType.simpleString()}" for n, c in [("a_" + seq, "b_" + seq), *zip(own, own, strict=True)])
    return rows.select(*own, *columns).toDF(*own, *[f"_{n}" for n in names]).mapInArrow(through, schema)
