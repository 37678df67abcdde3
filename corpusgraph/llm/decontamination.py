"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.byte_words import find_words, gram_hashes, row_blocks, text_bytes, word_bytes, word_hashes
from corpusgraph.plans.scratch import discard, materialize
from corpusgraph.plans.skew import free_name

#: ASCII characters that no word holds: all but digits and lower-case letters (texts are lower-cased first).
_IS_WORD = word_bytes("".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)))
GRAM = 5  # words in a fingerprinted gram
_FILTER = 1 << 20


def _winnow(grams: np.ndarray, row: np.ndarray, window: int, span: int) -> np.ndarray:
    """Gram positions kept: the least hash of every ``window`` consecutive grams of one row (the
    rightmost of equals).  Any ``span`` = GRAM + window - 1 words hold a kept gram."""
    n = len(row) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        other = grams[j : j + n]
        less = other <= best
        np.copyto(best, other, where=less)
        at[less] = j
    whole = row[:n] == row[span - 1 :]
    keep = np.zeros(len(grams), bool)
    keep[(at + np.arange(n))[whole]] = True
    return np.flatnonzero(keep)


class BenchmarkIndex:
    """Winnowed fingerprints of one block of benchmark items, with the words to extend hits on."""

    def __init__(self, ids: list[str], texts: list[str], span: int):
        self.span, self.ids, self.words, self.hashes, self.short = span, ids, [], [], {}
        table: dict[int, list[tuple[int, int]]] = {}
        column = pa.array(texts, pa.large_string())
        data, offsets = text_bytes(column)
        for i in range(len(ids)):
            b, s, e, row = find_words(data, offsets[i : i + 2], _IS_WORD)
            h = word_hashes(b, s, e)
            raw = b.tobytes()
            self.words.append([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])
            self.hashes.append(h)
            if 0 < len(h) < span:
                self.short.setdefault(len(h), {}).setdefault(int(gram_hashes(h, len(h))[0]), []).append(i)
            g = gram_hashes(h, GRAM)
            for p in _winnow(g, row, span - GRAM + 1, span).tolist():
                table.setdefault(int(g[p]), []).append((i, p))
        self.table = table
        self.filter = self._filter(table)
        self.short_filter = {k: self._filter(v) for k, v in self.short.items()}

    @staticmethod
    def _filter(keys) -> np.ndarray:
        out = np.zeros(_FILTER, bool)
        if keys:
            out[np.fromiter(keys, np.uint64, len(keys)) & np.uint64(_FILTER - 1)] = True
        return out

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[set[str]]]:
        """Of each row: its number of words, merged hit runs [start, end, ...] and items found."""
        n_rows = len(offsets) - 1
        b, starts, ends, row = find_words(data, offsets, _IS_WORD)
        n_words = np.bincount(row, minlength=n_rows)
        first = np.concatenate([[0], np.cumsum(n_words)])
        h = word_hashes(b, starts, ends)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n_rows)]
        items: list[set[str]] = [set() for _ in range(n_rows)]
        raw = b.tobytes() if len(b) else b""
        word = lambda i: raw[starts[i] : ends[i]]

        g = gram_hashes(h, GRAM)
        at = _winnow(g, row, self.span - GRAM + 1, self.span)
        at = at[self.filter[g[at] & np.uint64(_FILTER - 1)]]
        covered: dict[tuple[int, int, int], int] = {}
        for p, key in zip(at.tolist(), g[at].tolist(), strict=True):
            for item, q in self.table.get(key, ()):
                r = int(row[p])
                diagonal = (r, item, p - q)
                if covered.get(diagonal, -1) > p:
                    continue
                w, ih = self.words[item], self.hashes[item]
                lo, hi, low, high = 0, 0, int(first[r]), int(first[r + 1])
                while q + hi < len(w) and p + hi < high and h[p + hi] == ih[q + hi] and word(p + hi) == w[q + hi]:
                    hi += 1
                while q - lo > 0 and p - lo > low and h[p - lo - 1] == ih[q - lo - 1] and word(p - lo - 1) == w[q - lo - 1]:
                    lo += 1
                covered[diagonal] = p + max(hi, 1)
                if lo + hi >= self.span:
                    found[r].append((p - lo - low, p + hi - low))
                    items[r].add(self.ids[item])
        for k, table in self.short.items():
            g = gram_hashes(h, k)
            ok = self.short_filter[k][g & np.uint64(_FILTER - 1)] & (row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool))
            for p in np.flatnonzero(ok).tolist():
                for item in table.get(int(g[p]), ()):
                    if all(word(p + j) == self.words[item][j] for j in range(k)):
                        r = int(row[p])
                        found[r].append((p - int(first[r]), p + k - int(first[r])))
                        items[r].add(self.ids[item])
        return n_words, [merge_runs(x) for x in found], items


def merge_runs(runs: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(runs):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, span: int, block_bytes: int) -> Iterator[BenchmarkIndex]:
    """Indexes of the benchmark in blocks of about ``block_bytes``, each small enough to broadcast."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = total // block_bytes + 1
    for block in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block)
        got = part.collect()
        yield BenchmarkIndex([r["i"] for r in got], [r["t"] for r in got], span)


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = 10, block_bytes: int = 8 << 20, names: tuple[str, str, str] | None = None) -> DataFrame:
    """Add ``_n_words``, ``_runs`` (merged word runs, [start, end, start, end, ...]) and ``_items``.

    A benchmark window is ``span`` consecutive words of an item, or a whole item that is shorter.
    Every kept fingerprint of a document is looked up among those of the benchmark, and a match
    is extended on the words themselves; winnowing guarantees that every shared span holds one.
    The benchmark is broadcast in blocks of a bounded size, one at a time: with several, the table
    is written after each, and the block before is gone from the driver and the executors.  Nothing
    is shuffled.  ``names`` are other names for the three columns, where the table has these.

    Null or empty texts have no words and no hits; a null item id counts as the empty string;
    repeated rows stay; other columns pass through.
    """
    n_words, run_list, item_list = names or ("_n_words", "_runs", "_items")
    out = docs.withColumn(n_words, F.lit(0).cast("long")).withColumn(run_list, F.array().cast("array<int>")).withColumn(item_list, F.array().cast("array<string>"))
    schema, shared = out.schema, None
    for index in _blocks(benchmark, item, item_text, span, block_bytes):
        if shared is not None:  # the pass over the last block ends, and its index goes, before the next one
            done = materialize(out, "benchmark-pass")
            shared.destroy()
            discard(out)
            out = done
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches, shared=shared):
            for batch in batches:
                data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
                at = {c: batch.schema.get_field_index(c) for c in (n_words, run_list, item_list)}
                runs, items, counts = batch.column(at[run_list]).to_pylist(), batch.column(at[item_list]).to_pylist(), []
                for i, j in row_blocks(offsets):
                    n, more, names = shared.value.runs(data, offsets[i : j + 1])
                    counts.append(n)
                    for k in range(j - i):
                        if more[k]:
                            old = runs[i + k]
                            runs[i + k] = merge_runs([*zip(old[::2], old[1::2], strict=True), *zip(more[k][::2], more[k][1::2], strict=True)])
                            items[i + k] = sorted({*items[i + k], *names[k]})
                columns = list(batch.columns)
                columns[at[n_words]] = pa.array(np.concatenate(counts) if counts else [], pa.int64())
                columns[at[run_list]] = pa.array(runs, pa.list_(pa.int32()))
                columns[at[item_list]] = pa.array(items, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(scan, schema)
    return out


def n_hit(runs: str = "_runs"):
    """Words in merged runs: the sum of ends less the sum of starts."""
    return F.aggregate(F.transform(F.col(runs), lambda v, i: F.when(i % 2 == 1, v).otherwise(-v)), F.lit(0), lambda a, v: a + v).cast("long")


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest per document: words, words hit, and which items were found."""
    hits = find_hits(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark).drop("text")
    return hits.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("_items"), ","), 256).alias("items_sha256"), (F.size("_runs") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a benchmark window, with their own columns."""
    names = tuple(free_name(docs, c) for c in ("_n_words", "_runs", "_items"))
    return find_hits(docs, benchmark, text, names=names).where(F.size(names[1]) == 0).drop(*names)
