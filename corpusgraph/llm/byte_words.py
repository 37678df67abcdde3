"""Words of whole Arrow batches found on their UTF-8 bytes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def word_bytes(pattern_excludes: str) -> np.ndarray:
    """Membership table over bytes: all but the ASCII characters given (non-ASCII bytes belong)."""
    table = np.ones(256, dtype=bool)
    for c in pattern_excludes:
        table[ord(c)] = False
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the rows' offsets in them; null texts are empty."""
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def row_blocks(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes (a longer row makes a run of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 << 20), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (ASCII) bytes of the rows, word starts and ends in them, and each word's row."""
    lo = int(offsets[0])
    b = _LOWER[data[lo : int(offsets[-1])]]
    if not len(b):
        z = np.zeros(0, np.int64)
        return b, z, z, z
    m = is_word[b]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    cuts = offsets[:-1] - lo
    cuts = cuts[(cuts > 0) & (cuts < len(b))]
    first[cuts], last[cuts - 1] = m[cuts], m[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return b, starts, ends, np.searchsorted(offsets - lo, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words, from one running sum over the bytes."""
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(b)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, len(b) + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words (run i starts at word i)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * np.uint64(_BASE) + words[j : j + n]
    return mix(h)
