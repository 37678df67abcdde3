"""Feedback files as a stream into the feedback table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusgraph.sources.io import FEEDBACK


def stream_feedback(spark: SparkSession, incoming: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append every JSON feedback file that arrives, exactly once; rows without a rating are left out."""
    rows = spark.readStream.schema(FEEDBACK).json(incoming).where("rating is not null")
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
