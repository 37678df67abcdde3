"""Token counts of whole texts, long ones by overlapping chunks that are spliced where they agree.

A text up to CHUNK characters is taken at once: where the tokenizer never joins what white space
parts (``adds_up``), as the sum over its parts, each encoded by the library the first time a worker
meets it.  A longer one is cut into chunks that share
an overlap with the next; chunks are rows of their own, so one huge text is spread over tasks and
none holds more than a chunk's encoding.  Of two neighbours, the left one is right up to a boundary
that it finds, the right one from a boundary on that both find: the pre-tokenizer reads from left
to right and looks at nothing before a word's start.  They are spliced at the first common word
start that is proven stable (``_stable``).  A text with a pair of chunks that have none is taken
again with wider chunks and overlaps, at last as a whole.

The tokenizer is a ``tokenizers`` file whose pre-tokenizer splits by a pattern read from left to
right, and whose normalizer works character by character besides canonical composition and white
space.

Odd input: a null text has no bytes and no tokens, like an empty one; repeated rows and rows
without a key are counted each; an empty table gives no rows; other columns are ignored, whatever
their names; texts are read whole, whatever their length.  White space and special strings are
treated as the library does by default.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import discard, materialize, shuffle_partitions

CHUNK, OVERLAP = 1 << 15, 1 << 10
#: How much wider chunks and overlaps get where neighbours don't agree.
WIDER = (2, 8)
LIMIT = 2048
#: Characters of texts that are encoded in one call.
CALL = 1 << 19
#: Parts of at most so many characters are remembered, up to so many a worker.
KNOWN_CHARS, KNOWN_PARTS = 48, 1 << 19
_SPACES = frozenset(" \t\n\r\x0b\x0c\x85\xa0")

_SUMMARY = "row long, part int, parts int, total long, left_at array<int>, left_before array<long>, right_at array<int>, right_before array<long>"


@lru_cache(maxsize=4)
def load(path: str):
    """A worker's tokenizer for a vocabulary file; the tasks of an executor share its cores already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=4)
def special_length(path: str) -> int:
    """Characters of the longest string that the tokenizer takes as one token before it splits words."""
    return max((len(t.content) for t in load(path).get_added_tokens_decoder().values()), default=0)


@lru_cache(maxsize=4)
def adds_up(path: str) -> bool:
    """Whether a text's tokens are those of its parts between spaces and line ends, by the vocabulary's file.

    So it is where the words that the first pattern finds hold no white space and depend on nothing
    beside them, no special string has any, and normalizing works on white space or single characters.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = spec.get("pre_tokenizer") or {}
    first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
    pattern = first.get("pattern", {}).get("Regex", "") if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") else ""
    normal = spec.get("normalizer") or {}
    steps = normal["normalizers"] if normal.get("type") == "Sequence" else [normal] if normal else []
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in steps)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    return bool(pattern) and "(?" not in pattern and not regex.search(pattern, " \t\r\n") and plain and not any(c.isspace() for t in special for c in t)


_known: dict[str, dict[str, int]] = {}


def _encoded_lengths(path: str, texts: list[str]) -> list[int]:
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CALL):
            size += len(texts[j])
            j += 1
        out += [len(e.ids) for e in load(path).encode_batch_fast(texts[i:j], add_special_tokens=False)]
        i = j
    return out


def lengths(path: str, texts: list[str]) -> list[int]:
    """The tokens of each text, whole."""
    if not adds_up(path):
        return _encoded_lengths(path, texts)
    known, out = _known.setdefault(path, {"": 0}), []
    for text in texts:
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = [known.get(p) for p in parts]
        if None in found:
            new = list({p for p, n in zip(parts, found, strict=True) if n is None})
            here = dict(zip(new, _encoded_lengths(path, new), strict=True))
            found = [here[p] if n is None else n for p, n in zip(parts, found, strict=True)]
            if len(known) + len(here) > KNOWN_PARTS:
                known.clear()
                known[""] = 0
            known.update((p, n) for p, n in here.items() if len(p) <= KNOWN_CHARS)
        out.append(sum(found))
    return out


def _stable(text: str, at: int) -> bool:
    """Whether normalizing can't join the character with the one before it or put them in another order.

    True after white space, and for ASCII characters, punctuation and symbols, none of which
    composes with what stands before it or changes its length in lower case.
    """
    c = text[at]
    return c < "\x80" or text[at - 1] in _SPACES or unicodedata.category(c)[0] in "PS"


def word_starts(path: str, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Where words (and special tokens) start in ``text``, the tokens before each, and all tokens."""
    e = load(path).encode(text, add_special_tokens=False)
    n = len(e.ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    at = np.fromiter((a for a, _ in e.offsets), np.int64, n)
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    first = np.flatnonzero(new)
    keep = np.ones(len(first), bool)
    keep[1:] = at[first][1:] != at[first][:-1]  # words made from one character: the first of them
    return at[first][keep], first[keep], n


def summary(path: str, text: str, part: int, parts: int, overlap: int) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """A chunk's tokens, and its stable word starts within both overlaps with the tokens before each.

    Places count from the overlap's start.  Left out are the overlap's first word, which may be
    the rest of one, and starts so near its end that a special string may be cut there.
    """
    at, before, total = word_starts(path, text)
    out: list = [total]
    for exists, lo in ((part > 0, 0), (part < parts - 1, len(text) - overlap)):
        hi = lo + overlap - special_length(path) - 1
        i, j = np.searchsorted(at, [lo + 1, hi]) if exists else (0, 0)
        i += 1 if exists else 0
        fit = [k for k in range(i, j) if _stable(text, int(at[k]))]
        out += [(at[fit] - lo).tolist(), before[fit].tolist()]
    return tuple(out)


def _cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``(row, part, parts, text)``: chunks of ``chunk`` characters, each with ``overlap`` of the next, dealt over tasks."""

    def scan(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = text.as_py()
                parts = max(1, -(-(len(whole) - overlap) // chunk))
                for part in range(parts):
                    end = len(whole) if part == parts - 1 else (part + 1) * chunk + overlap
                    yield pa.RecordBatch.from_pylist([{"row": row, "part": part, "parts": parts, "text": whole[part * chunk : end]}], schema=schema)

    schema = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("text", pa.string())])
    return texts.select("row", "text").mapInArrow(scan, "row long, part int, parts int, text string").repartition(shuffle_partitions(texts.sparkSession), "row", "part")


def _encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            rows, nums, of, texts = (batch.column(i) for i in range(4))
            for i in range(len(rows)):
                found = summary(path, texts[i].as_py(), nums[i].as_py(), of[i].as_py(), overlap)
                yield pa.RecordBatch.from_arrays([rows.slice(i, 1), nums.slice(i, 1), of.slice(i, 1), *[pa.array([x], t) for x, t in zip(found, types, strict=True)]], names=names)

    types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = ["row", "part", "parts", "total", "left_at", "left_before", "right_at", "right_before"]
    return chunks.mapInArrow(scan, _SUMMARY)


def spliced(encoded: DataFrame) -> DataFrame:
    """``(row, n_tokens)`` of summaries; null where two neighbours have no common stable boundary.

    A splice takes away the left chunk's tokens from the boundary on and the right one's before it.
    """
    right = encoded.where("part < parts - 1").select("row", (F.col("part") + 1).alias("part"), "right_at", "right_before", F.col("total").alias("_all"))
    left = encoded.where("part > 0").select("row", "part", "left_at", "left_before")
    common = F.array_min(F.array_intersect("right_at", "left_at"))
    place = lambda c: F.array_position(c, F.col("_at")) - 1
    pairs = right.join(left, ["row", "part"]).withColumn("_at", common)
    twice = F.col("_all") - F.get("right_before", place("right_at")) + F.get("left_before", place("left_at"))
    cuts = pairs.select("row", F.lit(0).cast("long").alias("total"), twice.alias("twice"))
    both = encoded.select("row", "total", F.lit(0).cast("long").alias("twice")).unionByName(cuts)
    return both.groupBy("row").agg(F.when(F.count_if(F.col("twice").isNull()) == 0, F.sum("total") - F.sum("twice")).alias("n_tokens"))


def long_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(row, n_tokens)`` of written ``(row, text)``, each round on the texts that the one before couldn't splice."""
    found = None
    while True:
        encoded = materialize(_encoded(_cut(texts, chunk, overlap), path, overlap), "token-chunks")  # read three times
        counted = materialize(spliced(encoded), "token-counts")
        discard(encoded)
        done = counted.where("n_tokens is not null")
        found = done if found is None else found.unionByName(done)
        open_ = counted.where("n_tokens is null")
        if open_.isEmpty():
            return found
        texts = texts.join(open_.select("row"), "row", "left_semi")
        chunk, overlap = WIDER[0] * chunk, WIDER[1] * overlap
        overlap = min(overlap, chunk)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every row."""
    if not 0 < special_length(path) + 2 < overlap <= chunk:
        raise ValueError("an overlap holds more than the longest special string, and no more than a chunk")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), size.alias("n_bytes"))
    is_long = F.coalesce(F.length("_text") > chunk + overlap, F.lit(False))
    key_type = docs.schema[key].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            counts = lengths(path, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["_key", "n_bytes", "n_tokens"])

    counted = rows.where(~is_long).mapInArrow(scan, f"_key {key_type}, n_bytes long, n_tokens long")
    long_rows = materialize(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    if not long_rows.isEmpty():
        found = long_counts(long_rows.select("row", F.col("_text").alias("text")), path, chunk, overlap)
        counted = counted.unionByName(long_rows.select("row", "_key", "n_bytes").join(found, "row").select("_key", "n_bytes", "n_tokens"))
    else:
        discard(long_rows)
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
