"""What a web service calls: the document list, search, and feedback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import metrics
from corpusgraph.operators import embedding, graph, rag
from corpusgraph.sources import io


class SearchService:
    """A loaded run: nodes with vectors, and the edges of their graph."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, key: str = "node_id", name: str = "file_name", text: str = "text", model: Callable[[str], str] | None = None):
        self.spark, self.nodes, self.edges, self.key, self.name, self.text, self.model = spark, nodes, edges, key, name, text, model

    def documents(self) -> DataFrame:
        return graph.document_names(self.nodes, self.name).orderBy(self.name)

    def search(self, question: str, document: str | None = None, k: int = 3) -> DataFrame:
        """Answer one question, anchored in ``document`` if one is chosen; refused if that is unknown."""
        nodes = rag.anchor_filter(self.nodes, self.name, document)
        if nodes.isEmpty():
            raise ValueError(f"no nodes of document {document!r}")
        asked = embedding.embed_queries(self.spark.createDataFrame([(0, question)], "query_id long, question string"), "question", "q")
        scored = nodes.crossJoin(F.broadcast(asked)).select("query_id", F.col(self.key).alias("node_id"), F.round(metrics.dot(F.col("embedding"), F.col("q")), 6).alias("score"))
        return rag.answer(self.nodes, self.edges, scored, asked.drop("q"), self.key, self.text, k, self.model)

    def feedback(self, row: dict, path: str) -> None:
        io.append_feedback(self.spark, [row], path)
