"""Packing token pieces into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

import heapq
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.plans.positions import global_positions, long_array
from corpusgraph.plans.scratch import materialize

LENGTH = 4096
#: Piece lengths are rounded up to so many different sizes for the linear program.
CLASSES = 256
END_ID = 2
#: Entries of at most so many characters are remembered, up to so many of each kind a worker.
_CACHED_CHARS, _CACHED_PARTS, _CACHED_WORDS = 48, 400_000, 800_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: How the vocabulary's file splits a normalised text; a fixed value, for texts of the characters below.
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
#: Any other character (or a special token's bracket) leaves a part to the tokenizer as a whole.
_OTHER = re.compile("[^!-~À-ÖØ-öø-ÿ¡¿«»‘’“”–—…]|<\\|")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Token ids of whole texts, with the ids of frequent words remembered.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of
    its parts between spaces, tabs and line ends.  Parts of plain characters are split as the
    vocabulary's file says and looked up word by word; a new word goes to the tokenizer's model,
    and any other part to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
            ids = np.array([t.id for t in tokens], "<u4").tobytes()
            if len(word) <= _CACHED_CHARS:
                if len(self.words) >= _CACHED_WORDS:
                    self.words = {}
                self.words[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        if _OTHER.search(part):
            ids = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            ids = b"".join([self._word(w) for w in _PRETOKEN.findall(part.lower())])
        if len(part) <= _CACHED_CHARS:
            if len(self.parts) >= _CACHED_PARTS:
                self.parts = {"": b""}
            self.parts[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, without an end id."""
        known, part = self.parts, self._part
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = [known.get(p) for p in parts]
        if None in found:
            found = [part(p) if f is None else f for p, f in zip(parts, found, strict=True)]
        return b"".join(found)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file; a worker keeps it from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` tokens of every document's ids (its text's, then ``end_id``).

    ``with_ids`` adds the ids as little-endian 32-bit integers (binary ``ids``).
    """
    end = np.array([end_id], "<u4").tobytes()

    def scan(batches):
        words = tokenizer(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(0, len(ids), 200):
                rows = []
                for doc, doc_text in zip(ids[i : i + 200].to_pylist(), texts[i : i + 200].to_pylist(), strict=True):
                    data = words.ids(doc_text or "") + end
                    n = len(data) // 4
                    for at in range(0, n, length):
                        piece = data[4 * at : 4 * (at + length)]
                        rows.append((doc, at, len(piece) // 4, zlib.crc32(piece), n, *([piece] if with_ids else [])))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.binary()) for c in cols[5:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, PIECES + ", ids binary" * with_ids)


def length_classes(histogram: dict[int, int], limit: int = CLASSES) -> list[int]:
    """At most ``limit`` sizes to round piece lengths (``length -> pieces``) up to, with little waste.

    Every length is a size at first; then the size whose pieces lose least by going up to the next
    one is given up, until ``limit`` are left.  Sizes are lengths that occur, so a length that many
    pieces have stays exact.
    """
    sizes = sorted(histogram)
    count, above = dict(histogram), dict(zip(sizes, sizes[1:], strict=False))
    below = {b: a for a, b in above.items()}
    heap = [(count[s] * (t - s), s, t) for s, t in above.items()]
    heapq.heapify(heap)
    while len(count) > limit:
        waste, s, t = heapq.heappop(heap)
        if s not in count or above[s] != t or waste != count[s] * (t - s):
            continue
        count[t] += count.pop(s)
        del above[s]
        for lower, upper in ((below.pop(s, None), t), (t, above.get(t))):
            if lower is not None and upper is not None:
                above[lower] = upper
                below[upper] = lower
                heapq.heappush(heap, (count[lower] * (upper - lower), lower, upper))
        if below.get(t) == s:
            del below[t]
    return sorted(count)


def _best_pattern(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of ``sizes`` within ``capacity``, as counts.

    Sizes enter one by one; one more of a size is a running maximum along every ``size``-th cell.
    """
    best, kept = np.zeros(capacity + 1), []
    for i, s in enumerate(sizes):
        if value[i] <= best[s]:
            continue
        steps = -(-(capacity + 1) // s)
        cells = np.full(steps * s, -np.inf)
        cells[: capacity + 1] = best
        gain = value[i] * np.arange(steps)[:, None]
        kept.append((i, best))
        best = (np.maximum.accumulate(cells.reshape(steps, s) - gain, axis=0) + gain).ravel()[: capacity + 1]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    total = best[capacity]
    for i, before in reversed(kept):
        k = np.arange(c // sizes[i] + 1)
        n = int((before[c - k * sizes[i]] + k * value[i]).argmax())
        counts[i], c = n, c - n * sizes[i]
    return total, counts


def generate_columns(demand: dict[int, int], capacity: int, gap: float = 1e-3, max_rounds: int = 20000) -> list[tuple[dict[int, int], float]]:
    """Fractional patterns that meet ``demand`` (size -> pieces) with the fewest sequences.

    Revised simplex over an implicit set of patterns; a knapsack over the dual prices finds the
    entering pattern.  Ends when no pattern improves, or when the price bound proves the value
    within ``gap``.
    """
    sizes = sorted(s for s, d in demand.items() if d > 0)
    if not sizes:
        return []
    m = len(sizes)
    need = np.array([demand[s] for s in sizes], float)
    columns = [{s: capacity // s} for s in sizes]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ need
    for _ in range(max_rounds):
        price = inverse.sum(axis=0)
        worth, pattern = _best_pattern(sizes, np.maximum(price, 0), capacity)
        if worth <= 1 + 1e-9 or x.sum() * (1 - 1 / worth) <= gap * x.sum():
            break
        counts = pattern.astype(float)
        step = inverse @ counts
        ok = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / step[ok]
        r = int(ratio.argmin())
        theta = ratio[r]
        x = np.maximum(x - theta * step, 0)
        x[r] = theta
        pivot = inverse[r] / step[r]
        inverse -= np.outer(step, pivot)
        inverse[r] = pivot
        columns[r] = {s: int(k) for s, k in zip(sizes, pattern.tolist(), strict=True) if k}
    return list(zip(columns, x.tolist(), strict=True))


def round_patterns(demand: dict[int, int], fractional: list[tuple[dict[int, int], float]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of patterns that use every piece once: floors, then largest pieces first."""
    left, out = dict(demand), []
    for pattern, x in sorted(fractional, key=lambda p: -p[1]):
        n = int(x + 1e-9)
        n = min([n, *(left[s] // k for s, k in pattern.items())])
        if n:
            out.append((pattern, n))
            for s, k in pattern.items():
                left[s] -= k * n
    while any(left.values()):
        room, pattern = capacity, {}
        for s in sorted((s for s, n in left.items() if n), reverse=True):
            k = min(left[s], room // s)
            if k:
                pattern[s] = k
                room -= s * k
        n = max(1, min(left[s] // k for s, k in pattern.items()))
        out.append((pattern, n))
        for s, k in pattern.items():
            left[s] -= k * n
    return out


class Assignment:
    """Ranked pieces of each size class -> sequence, by blocks of rank ranges (sorted arrays)."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        blocks, used, sequence = [], {}, 0
        for pattern, n in patterns:
            for s, k in pattern.items():
                blocks.append((s, used.get(s, 0), k, sequence))
                used[s] = used.get(s, 0) + k * n
            sequence += n
        blocks.sort()
        self.cls, self.first, self.per, self.seq = (np.array(x, np.int64) for x in (zip(*blocks, strict=True) if blocks else ([], [], [], [])))
        self.key = (self.cls << 44) + self.first
        self.sequences = sequence

    def place(self, cls: np.ndarray, rank: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.key, (cls << 44) + rank, "right") - 1
        return self.seq[i] + (rank - self.first[i]) // self.per[i]


def pack(pieces: DataFrame, length: int = LENGTH, classes: int = CLASSES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.

    The histogram of lengths (at most ``length`` numbers) is all that the driver sees.  Pieces are
    ranked within their class over the whole table, and the rank decides the sequence.  Pieces are
    ranked by all that describes them, so those that tie are equal and may change places when a
    lost executor's task runs again.
    """
    spark = pieces.sparkSession
    # written first: the lengths are counted before pieces are ranked, and the pieces' ids are costly
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sizes = np.array(length_classes(histogram, classes), np.int64)
    up = sizes[np.searchsorted(sizes, np.arange(length + 1)).clip(max=len(sizes) - 1)].tolist() if len(sizes) else []
    counts: dict[int, int] = {}
    for n_tokens, n in histogram.items():
        counts[up[n_tokens]] = counts.get(up[n_tokens], 0) + n
    ranked, _ = global_positions(
        pieces.withColumn("_class", F.get(long_array(up), F.col("length").cast("int"))), ["_class", "doc_id", "start", "length", "ids_crc32", "doc_tokens"], F.lit(1), "_at", "pack",
    )
    starts, total = np.zeros(length + 1, np.int64), 0
    for c in sorted(counts):
        starts[c], total = total, total + counts[c]
    rest = {c: n for c, n in counts.items() if c < length}
    patterns = round_patterns(rest, generate_columns(rest, length), length) + [({c: 1}, n) for c, n in counts.items() if c == length]
    shared = spark.sparkContext.broadcast((Assignment(patterns), starts))

    def scan(batches):
        plan, start = shared.value
        for batch in batches:
            names = batch.schema.names
            cls, at = (batch.column(names.index(c)).to_numpy() for c in ("_class", "_at"))
            columns = [*batch.columns, pa.array(plan.place(cls, at - start[cls]) if len(cls) else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id"])

    placed = ranked.mapInArrow(scan, ranked.withColumn("sequence_id", F.lit(0).cast("long")).schema)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("_class", "_at")


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequences.

    A null or empty text is the end id alone; a null key stays null; repeated rows are documents
    of their own; an empty table gives an empty result.
    """
    return pack(cut(docs, tokenizer_path, key, text))


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Token sequences ``(sequence_id, n_tokens, ids)`` of packed pieces that carry ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    body = F.aggregate(F.transform("p", lambda x: x["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(length) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.concat(body, pad).alias("ids"))
