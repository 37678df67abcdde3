"""Overlapping token chunks of texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 256, 25


def _by_separator(text: str, sep: str) -> list[str]:
    """Pieces between separators; each but the first keeps its separator in front."""
    first, *rest = text.split(sep)
    return [p for p in [first, *(sep + r for r in rest)] if p]


def split_pieces(text: str, size: int, count: Callable[[str], int], separators: tuple[str, ...]) -> list[tuple[str, int]]:
    """Pieces of at most ``size`` tokens with their counts: the first separator that divides an
    oversize piece divides it, and characters if none does."""
    out, todo = [], [text]
    while todo:
        piece = todo.pop()
        n = count(piece)
        if n <= size or len(piece) <= 1:
            out.append((piece, n))
            continue
        parts = next((p for sep in separators if len(p := _by_separator(piece, sep)) > 1), None) or list(piece)
        todo.extend(reversed(parts))
    return out


def merge_pieces(pieces: list[tuple[str, int]], size: int, overlap: int) -> list[str]:
    """Fill chunks greedily; the next one starts with up to ``overlap`` tokens of the last."""
    chunks, held, total = [], [], 0
    for piece, n in pieces:
        if total + n > size and held:
            if chunk := "".join(p for p, _ in held).strip():
                chunks.append(chunk)
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[1]
        held.append((piece, n))
        total += n
    if chunk := "".join(p for p, _ in held).strip():
        chunks.append(chunk)
    return chunks


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, count: Callable[[str], int] | None = None, separators: tuple[str, ...] = (" ", "\n")) -> list[str]:
    """Chunks of one text; an empty text is one empty chunk."""
    if overlap > size:
        raise ValueError(f"an overlap of {overlap} does not fit chunks of {size}")
    if not text:
        return [""]
    return merge_pieces(split_pieces(text, size, count or (lambda t: len(t.split())), separators), size, overlap)


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, count: Callable[[str], int] | None = None) -> DataFrame:
    """``(key, chunk_no, chunk)`` of all documents; ``count`` is the tokenizer (words by default)."""
    if overlap > size:
        raise ValueError(f"an overlap of {overlap} does not fit chunks of {size}")

    def scan(batches):
        for batch in batches:
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = chunk_text(t, size, overlap, count)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts), batch.column(0).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=[key, "chunk_no", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(scan, f"{key} {kind}, chunk_no int, chunk string")


def word_windows(docs: DataFrame, key: str, words, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Fixed windows of ``size`` words every ``size - overlap`` words, in built-in functions only."""
    step = size - overlap
    w = docs.select(key, words.alias("w"))
    n = F.greatest(F.lit(1), F.ceil((F.size("w") - overlap) / F.lit(step))).cast("int")
    rows = w.select(key, "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select(key, "chunk_no", F.array_join(F.slice("w", F.col("chunk_no") * step + 1, F.lit(size)), " ").alias("chunk"))
