"""Exact joins of strings by their longest common subsequence, through an inverted index of q-grams.

Two strings of lengths m and n that must share a subsequence of L characters lose at most m - L and
n - L others.  Each lost character spoils at most two of its string's bigrams, each one put in at
most one, so at least c = 3 L - m - n - 1 bigrams survive, at places that differ by no more than the
larger loss.  Every string is therefore filed under the rarest of its bigrams only, so many that
any c of them include k, at most SHARED (and under all their occurrences); pairs meet where they
share k, pass the length and place filters, and are then compared with bit-parallel arithmetic.  Pairs of lengths
for which c is below 1 (very short strings, or low bars) meet by single characters in the same way.

What a pair must share is a function of both lengths only, so one index serves ratio thresholds and
score bounds alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import materialize

#: So many of the most frequent grams are ranked by their counts; the others count as rarer.
RANKED = 1 << 14
#: Grams that candidates share, where as many survive.
SHARED = 3
#: Pairs compared at a time, and how far strings go that fit one machine word.
PAIRS, WORD = 1 << 13, 64

Need = Callable[[Column, Column], Column]


def _codes(strings: list[str], fill: int) -> np.ndarray:
    """Code points of strings of at most WORD characters, as rows filled up with ``fill``."""
    width = max(map(len, strings), default=0)
    out = np.full((len(strings), width), fill, np.int32)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    row = np.repeat(np.arange(len(strings)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _lcs_long(a: str, b: str) -> int:
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences, pair by pair.

    A row of the usual table is one machine word a pair (which cells don't grow), and all pairs
    take their next character at once; longer strings are compared with long integers.
    """
    out = np.zeros(len(a), np.int64)
    short = np.array([len(x) <= WORD and len(y) <= WORD for x, y in zip(a, b, strict=True)], bool)
    for i in np.flatnonzero(~short):
        out[i] = _lcs_long(a[i], b[i])
    every = np.flatnonzero(short)
    for lo in range(0, len(every), PAIRS):
        at = every[lo : lo + PAIRS]
        x, y = _codes([a[i] for i in at], -1), _codes([b[i] for i in at], -2)
        v = np.full(len(at), np.uint64(2**64 - 1))
        equal = np.zeros((len(at), WORD // 8), np.uint8)
        for j in range(x.shape[1]):
            packed = np.packbits(y == x[:, j : j + 1], axis=1, bitorder="little")
            equal[:, : packed.shape[1]] = packed
            u = v & equal.view("<u8")[:, 0]
            v = (v + u) | (v - u)
        n = np.fromiter((len(b[i]) for i in at), np.int64, len(at))
        mask = np.where(n == 0, np.uint64(0), np.uint64(2**64 - 1) >> np.minimum(64 - n, 63).astype(np.uint64))
        out[at] = n - np.bitwise_count(v & mask)
    return out


def ratio_need(threshold: float) -> Need:
    """What two strings must share for ``2 L / (m + n)`` of at least ``threshold``."""
    return lambda m, n: F.ceil(threshold * (m + n) / 2 - 1e-9)


def _grams(s: Column, q: int) -> Column:
    """``(g, p)`` of all runs of ``q`` characters."""
    places = F.sequence(F.lit(1), F.length(s) - (q - 1))
    return F.when(F.length(s) >= q, F.transform(places, lambda p: F.struct(F.substring(s, p, F.lit(q)).alias("g"), p.alias("p"))))


def _ranks(strings: DataFrame, q: int) -> DataFrame:
    """The RANKED most frequent grams with their counts: a table of bounded size."""
    counts = strings.select(F.explode(F.array_distinct(F.transform(_grams(F.col("s"), q), lambda x: x["g"]))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "g").limit(RANKED)


def _filed(strings: DataFrame, lengths: list[int], need: Callable[[np.ndarray, np.ndarray], np.ndarray], q: int, ranks: dict[str, int]) -> DataFrame:
    """``(s, m, k, g, p)``: the places under which a string is filed, against partners of ``lengths``, with at least ``k`` of which it meets them."""
    partners = np.array(lengths, np.int64)

    def least(m: int) -> int | None:
        """The fewest grams that survive with any partner of this kind, None where there is none."""
        want = need(np.full(len(partners), m), partners)
        survive = 3 * want - m - partners - 1
        possible = (want <= np.minimum(m, partners)) & (want > 0)
        chosen = possible & (survive >= 1) if q == 2 else possible & (survive < 1)
        if not chosen.any():
            return None
        return int((survive if q == 2 else want)[chosen].min())

    def scan(batches):
        known: dict[int, int | None] = {}
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for s in batch.column(0).to_pylist():
                m = len(s)
                if m not in known:
                    known[m] = least(m)
                keep = known[m]
                if keep is None:
                    continue
                k = min(SHARED, keep)
                grams = sorted((ranks.get(s[i : i + q], 0), s[i : i + q], i) for i in range(m - q + 1))
                if not grams:
                    continue
                last = grams[min(len(grams) - 1, max(0, len(grams) - keep + k - 1))][:2]
                for rank, g, i in grams:
                    if (rank, g) > last:
                        break
                    for column, value in zip(out, (s, m, k, g, i), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    names, types = ["s", "m", "k", "g", "p"], [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
    return strings.select("s").mapInArrow(scan, "s string, m int, k int, g string, p int")


def _needed(need: Need, spark, sizes: set[int], others: set[int]) -> dict[tuple[int, int], int]:
    """``need`` of all pairs of lengths that occur (a small table)."""
    a = spark.createDataFrame([(m,) for m in sorted(sizes)], "m int")
    b = spark.createDataFrame([(n,) for n in sorted(others)], "n int")
    rows = a.join(F.broadcast(b)).select("m", "n", need(F.col("m"), F.col("n")).cast("int").alias("c")).collect()
    return {(r.m, r.n): r.c for r in rows}


def candidates(left: DataFrame, right: DataFrame, need: Need) -> DataFrame:
    """``(x, y)``: a superset of the pairs of strings (columns ``s``, written, distinct) that share ``need`` characters in order."""
    spark = left.sparkSession
    sizes = [{r.m for r in df.select(F.length("s").alias("m")).distinct().collect()} for df in (left, right)]
    table = _needed(need, spark, *sizes)

    def wanted(m: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.array([table[a, b] for a, b in zip(m.tolist(), n.tolist(), strict=True)], np.int64)

    def backwards(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return wanted(m, n)

    parts = []
    for q in (2, 1):
        ranks = {r.g: r.n for r in _ranks(left.union(right), q).collect()}
        a = _filed(left, sorted(sizes[1]), wanted, q, ranks).toDF("x", "m", "k", "g", "i")
        b = _filed(right, sorted(sizes[0]), backwards, q, ranks).toDF("y", "n", "l", "g", "j")
        m, n = F.col("m"), F.col("n")
        c = need(m, n)
        survive = 3 * c - m - n - 1
        fits = (c > 0) & (c <= F.least(m, n)) & (F.abs(F.col("i") - F.col("j")) <= F.greatest(m, n) - c) & (survive >= 1 if q == 2 else survive < 1)
        met = a.join(b, "g").where(fits).groupBy("x", "y", F.least("k", "l").alias("k")).agg(F.count_distinct("i").alias("i"), F.count_distinct("j").alias("j"))
        parts.append(met.where(F.least("i", "j") >= F.col("k")).select("x", "y"))
    return parts[0].union(parts[1])  # by their lengths, no pair is in both


def verified(pairs: DataFrame, need: Need) -> DataFrame:
    """``(x, y, lcs)`` of the pairs that share as much as they need."""

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays([x, y, pa.array(lcs_lengths(x.to_pylist(), y.to_pylist()))], names=["x", "y", "lcs"])

    return pairs.mapInArrow(scan, "x string, y string, lcs long").where(F.col("lcs") >= need(F.length("x"), F.length("y")))


def strings_of(df: DataFrame, column: str) -> DataFrame:
    return materialize(df.where(F.col(column).isNotNull()).select(F.col(column).alias("s")).distinct(), "strings")


def _both_empty(x: DataFrame, y: DataFrame) -> DataFrame:
    """The pair of two empty strings, which share nothing and are alike, where both sides have one."""
    return x.where("s = ''").join(y.where("s = ''"), "s").select(F.col("s").alias("x"), F.col("s").alias("y"))


def close_pairs(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float = 0.8) -> DataFrame:
    """``(x, y, ratio)``: all pairs of distinct values of ``left[a]`` and ``right[b]`` with a spelling ratio of ``threshold`` or more.

    The ratio is twice the longest common subsequence over both lengths.  Exact: no pair is lost.
    Thresholds over two thirds meet by bigrams; at lower ones more pairs meet by characters.  Nulls
    take no part; two empty strings are alike; repeated values count once; empty tables give no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies over 0 and is at most 1")
    x, y, need = strings_of(left, a), strings_of(right, b), ratio_need(threshold)
    found = verified(candidates(x, y, need), need)
    ratio = 2.0 * F.col("lcs") / (F.length("x") + F.length("y"))
    return found.select("x", "y", ratio.alias("ratio")).unionByName(_both_empty(x, y).withColumn("ratio", F.lit(1.0)))


def fuzzy_list_pairs(left: DataFrame, right: DataFrame, key: str, items: str, threshold: float = 0.8) -> DataFrame:
    """``(a, b, common, jaccard)``: rows whose lists share an item that is spelled alike, with the share of such items.

    Items are compared in lower case, once per distinct pair of spellings, and lists then meet by
    equality, so no two lists are compared as a whole.  ``common`` counts the distinct items of the
    left list that match an item of the right one; repeats count in the union, which is why
    ``jaccard`` is capped at 1.  Blank items never match; rows with a null key or list take no part.
    """
    own = lambda df: df.where(F.col(key).isNotNull() & F.col(items).isNotNull()).select(F.col(key).alias("k"), F.col(items).alias("l"))
    a, b = materialize(own(left), "lists"), materialize(own(right), "lists")
    spelled = lambda df: df.select("k", F.size("l").alias("n"), F.explode(F.array_distinct("l")).alias("item")).where(F.trim("item") != "").withColumn("s", F.lower("item"))
    x, y = spelled(a), spelled(b)
    alike = materialize(close_pairs(x, y, "s", "s", threshold).select("x", "y"), "alike")
    pairs = x.toDF("a", "na", "item", "x").join(alike, "x").join(y.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("s").alias("y")).distinct(), "y")
    common = pairs.groupBy("a", "b", "na", "nb").agg(F.count_distinct("item").alias("common"))
    union = F.col("na") + F.col("nb") - F.col("common")
    return common.select("a", "b", "common", F.bround(F.least(F.lit(1.0), F.coalesce(F.try_divide("common", union), F.lit(0.0))), 3).alias("jaccard"))


def _windows(short: str, long: str) -> list[str]:
    return [long[i : i + len(short)] for i in range(len(long) - len(short) + 1)]


def name_scores(pairs: DataFrame, x: str = "_x", y: str = "_y", floor: str | None = None) -> DataFrame:
    """Add ``score``: 0.4 ratio + 0.3 best window + 0.3 case-folded ratio of two columns of squeezed names.

    Windows are tried only where the other two parts leave the pair a chance to pass ``floor``
    (a column, none by default); a pair that can't gets a null score.
    """

    def ratio(a: list[str], b: list[str]) -> np.ndarray:
        total = np.array([len(p) + len(q) for p, q in zip(a, b, strict=True)])
        return np.where(total == 0, 1.0, 2.0 * lcs_lengths(a, b) / np.maximum(total, 1))

    def scan(batches):
        for batch in batches:
            a, b = batch.column(batch.schema.get_field_index(x)).to_pylist(), batch.column(batch.schema.get_field_index(y)).to_pylist()
            plain, folded = ratio(a, b), ratio([s.lower() for s in a], [s.lower() for s in b])
            low = np.array(batch.column(batch.schema.get_field_index(floor)).to_pylist(), float) if floor else np.full(len(a), -1.0)
            part = np.zeros(len(a))
            open_ = np.flatnonzero(0.4 * plain + 0.3 + 0.3 * folded >= low - 1e-6)
            i = 0
            while i < len(open_):
                at, short, window = [], [], []
                while i < len(open_) and len(at) < PAIRS:
                    p, q = sorted((a[open_[i]], b[open_[i]]), key=len) if len(a[open_[i]]) > len(b[open_[i]]) else (a[open_[i]], b[open_[i]])
                    tried = _windows(p, q) if p else []
                    at += [open_[i]] * len(tried)
                    short += [p] * len(tried)
                    window += tried
                    if not p:
                        part[open_[i]] = float(not q)
                    i += 1
                if at:
                    np.maximum.at(part, np.array(at), ratio(short, window))
            score = 0.4 * plain + 0.3 * part + 0.3 * folded
            passed = np.zeros(len(a), bool)
            passed[open_] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64(), mask=~passed)], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", score double"
    return pairs.mapInArrow(scan, schema).withColumn("score", F.round("score", 6))


def score_need(score: float) -> Need:
    """What two squeezed names must share, case aside, for a name score of ``score``.

    Both ratios are at most 2 L / (m + n), and the best window holds at most L of the shorter name.
    """
    return lambda m, n: F.ceil(score / (1.4 / F.greatest(m + n, F.lit(1)) + 0.3 / F.greatest(F.least(m, n), F.lit(1))) - 1e-6)


#: Scores that a best match is sought from; names without one that good go on to the next.
STEPS = (0.85, 0.7, 0.55)


def best_names(left: DataFrame, right: DataFrame, min_score: float, steps: tuple[float, ...] = STEPS, block_rows: int = 1024) -> DataFrame:
    """``(name, match, score)``: the best candidate over ``min_score`` of each name that has one.

    ``left`` holds ``(name, _x)``, ``right`` ``(match, _y)``, both written, with squeezed names.  A name
    settles at the first step that finds it a score as good as the step: all pairs that could beat it
    were there.  Names that no step settles meet all candidates, which travel in bounded blocks.
    Ties go to the shorter, then the smaller candidate.
    """
    first = F.min_by("b", F.struct(-F.col("b.score"), F.length("b.match"), F.col("b.match"))).alias("b")
    best = lambda scored: scored.where(F.col("score") > min_score).select("name", F.struct("match", "score").alias("b")).groupBy("name").agg(first)
    low = lambda df, c: df.withColumn("s", F.lower(c))
    open_, done = left, []
    spelled = low(right, "_y")
    y = strings_of(spelled, "s")
    for step in [s for s in steps if s > min_score] + ([min_score] if min_score > 0.5 else []):
        asked = low(open_, "_x")
        x = strings_of(asked, "s")
        near = verified(candidates(x, y, score_need(step)), score_need(step)).select("x", "y").unionByName(_both_empty(x, y))
        pairs = near.join(asked.withColumnRenamed("s", "x"), "x").join(spelled.withColumnRenamed("s", "y"), "y").select("name", "match", "_x", "_y", F.lit(step).alias("_low"))
        found = materialize(best(name_scores(pairs, floor="_low").where(F.col("score") >= step)), "matches")
        done.append(found)
        open_ = materialize(open_.join(found.select("name"), "name", "left_anti"), "names")
    if (not steps or min(steps) > min_score) and min_score <= 0.5 and not open_.isEmpty():
        n = right.count() // block_rows + 1
        for i in range(n):
            part = right if n == 1 else right.where(F.pmod(F.xxhash64("match"), F.lit(n)) == i)
            done.append(materialize(best(_against_all(open_, part)), "matches"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.groupBy("name").agg(first).select("name", "b.match", "b.score")


def _against_all(names: DataFrame, block: DataFrame) -> DataFrame:
    """Scores of all names with a block of candidates, of bounded size, that is sent to them."""
    rows = block.select("match", "_y").toArrow()
    shared = names.sparkSession.sparkContext.broadcast((rows["match"].to_pylist(), rows["_y"].to_pylist()))

    def scan(batches):
        match, spelled = shared.value
        step = max(1, PAIRS // max(1, len(match)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                one = pa.array(np.repeat(np.arange(part.num_rows), len(match)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(one), pa.array(match * part.num_rows, pa.string()), part.column(1).take(one), pa.array(spelled * part.num_rows, pa.string())], names=["name", "match", "_x", "_y"])

    return name_scores(names.select("name", "_x").mapInArrow(scan, "name string, match string, _x string, _y string"))
