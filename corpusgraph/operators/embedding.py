"""Text embeddings behind a plug-in, with a deterministic offline default."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
#: Fixed value: what queries are prefixed with.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def hashed_vector(text: str, dims: int = DIMENSIONS) -> np.ndarray:
    """Signed feature hashing of words, scaled to unit length (a text without words is zero)."""
    v = np.zeros(dims)
    for word in text.lower().split():
        h = zlib.crc32(word.encode())
        v[h % dims] += 1 if h & 0x80000000 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def embed(df: DataFrame, text: str, out: str = "embedding", model: Callable[[str], np.ndarray] = hashed_vector, prefix: str = "") -> DataFrame:
    """Add ``out`` (array of floats) for a text column; a null text has a null vector."""

    def scan(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            vectors = [None if t is None else np.asarray(model(prefix + t), np.float32).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    return df.mapInArrow(scan, df.withColumn(out, F.lit(None).cast("array<float>")).schema)


def embed_queries(df: DataFrame, text: str, out: str = "embedding", model: Callable[[str], np.ndarray] = hashed_vector) -> DataFrame:
    return embed(df, text, out, model, QUERY_PREFIX)
