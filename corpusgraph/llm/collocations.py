"""Phrase collocations: counted word n-grams, scored by how exclusively their parts go together.

All n-grams of one to ``max_n`` words become rows that are hash-aggregated per language, shorter
ones first: a phrase that is frequent has only frequent parts, so an n-gram with a rare part is
never emitted.  Parts are looked up in a bitmap of constant size, which lets some rare ones
through and no frequent one out; a full bitmap costs rows, never results.

Odd input: a null text is empty and a null language is ``und``; texts of any length are read whole
(a text longer than a block of BLOCK_BYTES makes a block of its own); repeated rows count as often
as they occur; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.byte_words import find_words, mix, row_blocks, text_bytes, word_bytes, word_hashes
from corpusgraph.plans.scratch import materialize
from corpusgraph.plans.skew import join_groups

MIN_COUNT, MAX_N, TOP = 30, 4, 2000
SCALE = 2_000_000
UNKNOWN = "und"
#: A phrase is dropped for a longer one with this share (in hundredths) of its occurrences.
COVERED = 80
BREAKS = ".,;:!?\n\x0b\x0c\r"
BLOCK_BYTES = 2 << 20
#: Bits of the map of frequent parts: 4 MB, whatever the corpus.
MAP_BITS = 25
#: Ranges that rank their best phrases before those of a language meet.
RANK_PARTS = 64

_IS_WORD = word_bytes(" \t" + BREAKS)
_IS_BREAK = ~word_bytes(BREAKS)
_GRAMS = "lang string, phrase string, words int, c long"


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of ``data`` as strings."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())]).cast(pa.string())


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    data, at = text_bytes(langs)
    return word_hashes(data, at[:-1], at[1:])


def _map_places(phrases: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return (mix(phrases ^ (langs * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _in_map(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 6] >> (places & 63)) & 1 == 1


class _Block:
    """The words of a run of rows: exact numbers of (language, word), and which follow in one piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, names: pa.Array):
        low, starts, ends, row = find_words(data, offsets, _IS_WORD)
        n, lengths = len(starts), ends - starts
        self.names, self.lang = names, lang[row]
        # words written one after the other with one space between: any run of them is a slice
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        self.ends = self.starts + lengths
        self.text = np.full(int(lengths.sum()) + n, 32, np.uint8)
        self.text[np.arange(int(lengths.sum())) + np.repeat(np.arange(n), lengths)] = low[_IS_WORD[low]]
        breaks = np.cumsum(_IS_BREAK[low])[starts] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
        self.piece = np.cumsum(new)
        spelled = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(self.starts, len(self.text))), pa.py_buffer(self.text)])
        self.word = spelled.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, self.word = np.unique(self.lang * (int(self.word.max()) + 1) + self.word, return_inverse=True) if n else (None, self.word)

    def whole(self, k: int) -> np.ndarray:
        """First words of the runs of ``k`` words within one piece."""
        n = len(self.piece) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def frequent(self, first: np.ndarray, k: int, bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which of the runs of ``k`` words the map has."""
        return _in_map(bits, _map_places(word_hashes(self.text, self.starts[first], self.ends[first + k - 1]), hashes[self.lang[first]]))

    def rows(self, first: np.ndarray, counts: np.ndarray, k: int) -> pa.RecordBatch:
        lang = self.names.take(pa.array(self.lang[first]))
        phrase = _gather(self.text, self.starts[first], self.ends[first + k - 1])
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(first), k, np.int32)), pa.array(counts)], names=["lang", "phrase", "words", "c"])


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, inverse and count of every value."""
    _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, counts


def count_grams(docs: DataFrame, sizes: tuple[int, ...], bits: np.ndarray | None, part: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, phrase, words, c)`` of all n-grams of ``sizes`` words whose parts of ``part`` words are in the map ``bits``.

    With size 1 there is one more row per language, its phrase null: the count of all words.
    Rows of a block are counted before they leave it, by exact numbers of their words; Spark
    combines the blocks of a partition and shuffles what is left.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text")).where("text is not null")
    shared = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            coded = batch.column(0).dictionary_encode()
            names, lang_of = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = _lang_hashes(names)
            for i, j in row_blocks(offsets, BLOCK_BYTES):
                block = _Block(data, offsets[i : j + 1], lang_of[i:j], names)
                yield from grams(block, hashes)

    def grams(block: _Block, hashes: np.ndarray):
        if not len(block.word):
            return
        if 1 in sizes:
            first, _, counts = _counted(block.word)
            yield block.rows(first, counts, 1)
            total = np.bincount(block.lang)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [block.names.take(pa.array(some)), pa.nulls(len(some), pa.string()), pa.array(np.zeros(len(some), np.int32)), pa.array(total[some])], names=["lang", "phrase", "words", "c"]
            )
        if max(sizes) < 2:
            return
        # kept[i]: the part that starts at word i is in the map
        kept, n = np.ones(len(block.word), bool), len(block.word)
        number, at = block.word, np.arange(n)
        for k in range(1, max(sizes) + 1):
            if k > 1:
                at = block.whole(k)
                if shared is not None and k > part:  # all parts within
                    at = at[np.logical_and.reduce([kept[at + i] for i in range(k - part + 1)])]
                if not len(at):
                    return
                key = number[at] * (int(block.word.max()) + 1) + block.word[at + k - 1]
                first, inverse, counts = _counted(key)
                number = np.full(n, -1, np.int64)
                number[at] = inverse
                if k in sizes:
                    yield block.rows(at[first], counts, k)
            else:
                first, inverse, _ = _counted(number)
            if shared is not None and k == part:
                kept = np.zeros(n, bool)
                kept[at] = block.frequent(at[first], k, shared.value, hashes)[inverse]

    return rows.mapInArrow(scan, _GRAMS).groupBy("lang", "phrase", "words").agg(F.sum("c").alias("c"))


def frequency_map(frequent: DataFrame) -> np.ndarray:
    """The map of ``(lang, phrase)``: at most 2^(MAP_BITS - 6) rows reach the driver, whatever the corpus."""

    def places(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(_map_places(word_hashes(data, at[:-1], at[1:]), _lang_hashes(batch.column(0))))], names=["p"])

    p = F.col("p")
    found = frequent.select("lang", "phrase").mapInArrow(places, "p long")
    words = found.groupBy(F.shiftright(p, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


def frequent_grams(docs: DataFrame, min_count: int = MIN_COUNT, max_n: int = MAX_N, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, c)`` of all n-grams with ``min_count`` occurrences, and ``(lang, n)``, as written tables."""
    often = (F.col("c") >= min_count) | F.col("phrase").isNull()
    levels = [materialize(count_grams(docs, (1,), None, 0, text, lang).where(often), "words")]
    steps = [((2,), 1), (tuple(range(3, max_n + 1)), 2)]
    for sizes, part in steps:
        if max(sizes, default=0) <= max_n and sizes:
            bits = frequency_map(levels[-1].where("phrase is not null"))
            levels.append(materialize(count_grams(docs, sizes, bits, part, text, lang).where(often), "grams"))
    totals = levels[0].where("phrase is null").select("lang", F.col("c").alias("n"))
    out = levels[0].where("phrase is not null")
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, totals


def _spaced(words: Column) -> Column:
    return F.array_join(words, " ")


def _with_count(cuts: DataFrame, grams: DataFrame, part: str, out: str) -> DataFrame:
    """Add the count of a part; parts that start or end very many phrases are split off."""
    wanted = cuts.groupBy("lang", part).agg(F.count("*").alias("_rows"))
    known = grams.select("lang", F.col("phrase").alias(part), F.col("c").alias(out))
    return join_groups(cuts, materialize(wanted.join(known, ["lang", part]), "parts"), ["lang", part], "_rows")


def score_phrases(grams: DataFrame, covered: int = COVERED) -> DataFrame:
    """``(lang, phrase, words, a, l, r, score)`` of the phrases of two words or more that no longer one covers.

    Counts are multiplied as decimals, so that no product is cut at 64 bits.  A longer phrase that
    covers a shorter one has a one-word extension of it inside that covers it as well, so one-word
    extensions decide.
    """
    phrases = grams.where("words >= 2").select("lang", "phrase", "words", F.col("c").alias("a"))
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = phrases.select("*", cut).select(
        "*", _spaced(F.slice(words, F.lit(1), F.col("k"))).alias("head"), _spaced(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k"))).alias("tail")
    )
    cuts = materialize(cuts, "cuts")
    counted = _with_count(_with_count(cuts, grams, "head", "l"), grams, "tail", "r")
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b")
    scored = counted.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(least).select("lang", "phrase", "words", "a", "b.*")
    inner = F.explode(F.array(_spaced(F.slice(words, F.lit(1), F.col("words") - 1)), _spaced(F.slice(words, F.lit(2), F.col("words") - 1)))).alias("phrase")
    longer = phrases.where("words >= 3").select("lang", F.col("a").alias("f"), inner).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    gone = (scored["lang"] == longer["lang"]) & (scored["phrase"] == longer["phrase"])
    gone = gone & F.expr(f"cast(100 as decimal(4,0)) * cast(f as decimal(20,0)) >= cast({covered} as decimal(4,0)) * cast(a as decimal(20,0))")
    return scored.join(longer, gone, "left_anti")


def rank_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score, count and spelling, with their rank from 1.

    Parts of a language rank their own best first, so that no task orders a whole language.
    """
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    local = scored.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    best = local.where(F.col("_rank") <= top).drop("_part", "_rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_n: int = MAX_N, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best phrases of 2 to ``max_n`` words.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut that scores lowest (the first of
    equals), ``n`` the language's words.
    """
    if min_count < 1 or max_n < 2:
        raise ValueError("min_count is at least 1 and max_n at least 2")
    grams, totals = frequent_grams(docs, min_count, max_n, text, lang)
    best = rank_phrases(score_phrases(grams), top)
    return best.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
