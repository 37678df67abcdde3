"""The two batch jobs: building a similarity-graph run, and a model-graded evaluation of it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import metrics, text
from corpusgraph.operators import chunking, embedding, graph, pairs, rag, scorers, stats, tuning
from corpusgraph.plans.positions import global_positions
from corpusgraph.plans.scratch import materialize
from corpusgraph.sources import io

N_CTX = 1600


def prepare_nodes(docs: DataFrame, key: str = "doc_id", body: str = "text", name: str = "source", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, model: Callable[[str], np.ndarray] = embedding.hashed_vector) -> DataFrame:
    """Chunks of all documents as numbered nodes with vectors, entities and links.

    Entities are taken from the raw chunk, vectors from the cleaned one.
    """
    chunks = materialize(chunking.chunk_documents(docs, key, body, size, overlap), "chunks")
    nodes, _ = global_positions(chunks, [key, "chunk_no"], F.lit(1), "node_id", "nodes")
    nodes = nodes.withColumn("entities", text.entities(F.col("chunk"))).withColumn("text", text.clean_text(F.col("chunk"))).withColumn("links", text.links(F.col("chunk")))
    files = docs.select(F.col(key).alias("_key"), F.col(name).alias("file_name"))
    nodes = nodes.join(files, nodes[key] == F.col("_key"), "left").drop("_key", "chunk")
    return materialize(embedding.embed(nodes, "text", model=model), "nodes")


def score_edges(nodes: DataFrame, scorer: str | scorers.Scorer = "dot", scale: bool = False) -> DataFrame:
    """All weighted pairs of nodes: blocked products for ``dot`` and ``cosine``, a theta join for any scorer."""
    if isinstance(scorer, str):
        edges = pairs.all_pairs(nodes, "node_id", "embedding", scorer)
    else:
        edges = pairs.theta_pairs(nodes, "node_id", scorer, scorer.columns).select(F.col("a_node_id").alias("src"), F.col("b_node_id").alias("dst"), F.round("weight", 6).alias("weight"))
    if scale:
        edges = scorers.robust_scale(edges).select("src", "dst", F.round("scaled", 6).alias("weight"))
    return materialize(edges, "edges")


def build_run(docs: DataFrame, root: str, experiment: str, run_id: str, scorer: str | scorers.Scorer = "dot", scale: bool = False, notes: str = "", **chunk_options) -> str:
    """Chunk, embed, score all pairs, tune the threshold, and save nodes, edges and parameters."""
    nodes = prepare_nodes(docs, **chunk_options)
    edges = score_edges(nodes, scorer, scale)
    best = tuning.tune_threshold(edges).first()
    threshold = float(best["threshold"]) if best and best["threshold"] is not None else 0.0
    params = docs.sparkSession.createDataFrame([(experiment, run_id, threshold, notes)], "experiment string, run_id string, edge_thresh double, notes string")
    return io.save_run({"nodes": nodes, "edges": graph.threshold_edges(edges, threshold), "params": params}, root, experiment, run_id)


def _flat(prompt: Column) -> Column:
    return F.array_join(F.transform(prompt, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def evaluate_qa(nodes: DataFrame, edges: DataFrame, root: str, n: int, asker: Callable[[str], str], critic: Callable[[str], str], answerer: Callable[[str], str], judge: Callable[[str], str], key: str = "node_id", body: str = "text", k: int = 3) -> DataFrame:
    """Questions from sampled nodes, critiques, a filter, answers through the graph, and a judge's scores.

    Each stage is written as JSON under ``root`` and read back.  Prompts longer than the model's
    window are skipped; completions without the asked marks are dropped or score 0.
    """
    seeds = stats.hash_sample(nodes, key, n)
    context = rag.context_text(seeds, key, key, body, "Context item")
    asked = context.withColumn("prompt", _flat(rag.chat_prompt(rag.QUESTION_SYSTEM, F.col("context")))).where(rag.fits_window(F.col("prompt"), N_CTX))
    asked = rag.generate(asked, "prompt", asker)
    question, answer = rag.parse_qa(F.col("completion"))
    raw = asked.select(F.col(key).alias("query_id"), "context", question.alias("question"), answer.alias("answer")).where("question is not null and answer is not null")
    rows = io.save_stage(raw, root, "qa_pairs_raw")
    for kind in rag.CRITIQUES:
        prompt = _flat(rag.critique_prompt(kind, F.col("question"), F.col("context") if kind == "groundedness" else None))
        rows = rag.generate(rows.withColumn("prompt", prompt), "prompt", critic)
        done = F.when(rag.fits_window(F.col("prompt"), N_CTX), "stop").otherwise("length")
        score, reason = rag.parse_critique(F.col("completion"), done)
        rows = rows.withColumns({f"{kind}_score": score, f"{kind}_rationale": reason}).drop("prompt", "completion")
    rows = io.save_stage(rows, root, "qa_pairs_evaluated")
    kept = rows.where(rag.passes_critiques(*[F.col(f"{kind}_score") for kind in rag.CRITIQUES]))
    vectors = materialize(embedding.embed_queries(kept.select(F.col("query_id").alias(key), "question"), "question"), "questions")
    scored = pairs.vector_top_k(nodes, vectors, 1, key)
    replies = rag.answer(nodes, edges, scored, kept.select("query_id", "question"), key, body, k, answerer).select("query_id", F.col("answer").alias("response"))
    answered = io.save_stage(kept.join(replies, "query_id"), root, "qa_pairs_answered")
    prompt = rag.fill(rag.JUDGE, instruction=F.col("question"), response=F.col("response"), reference=F.col("answer"))
    judged = rag.generate(answered.withColumn("prompt", prompt), "prompt", judge)
    score = F.when(rag.fits_window(F.col("prompt"), N_CTX), rag.parse_judge(F.col("completion"))).otherwise(F.lit("0"))
    return io.save_stage(judged.select(*answered.columns, F.col("completion").alias("judge_evaluation"), score.alias("judge_score")), root, "qa_pairs_judged")


def metric_table(nodes: DataFrame, seq: str, columns: list[str] | None = None) -> DataFrame:
    """The metric vector of all pairs of fully described nodes, and its row mean as ``average``.

    Items of lists match from 80 of 100 on the spelling ratio.  A metric of a null is null, and so is the mean.
    """
    cols = columns or scorers.MeanScorer.columns
    rows = pairs.theta_pairs(nodes, seq, lambda a, b: F.lit(None).cast("double"), cols)
    named = rows.select(f"a_{seq}", f"b_{seq}", *[c.alias(n) for n, c in zip(metrics.METRICS, metrics.metric_vector(close=metrics.close_match()), strict=True)])
    return named.withColumn("average", metrics.mean_score([F.col(n) for n in metrics.METRICS]))
