"""Retrieval-augmented answering and its evaluation, as DataFrame stages.

Model calls are plug-ins; everything before and after them is columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.metrics import dot
from corpusgraph.functions.text import context_clean, file_name
from corpusgraph.operators.embedding import embed_queries
from corpusgraph.operators.graph import anchor_nodes, context_nodes, shortest_paths
from corpusgraph.operators import vector_paths
from corpusgraph.operators.pairs import vector_top_k
from corpusgraph.operators.vector_graph import VectorGraph
from corpusgraph.plans.scratch import materialize

ANSWER_SYSTEM = "You answer questions from the documents given. Use only what they say, and say so if they do not hold the answer."
EXTRACT_TASK = "Find the answer in the contexts and write it out. Write none if they do not hold it, or are about something else."
QUESTION_SYSTEM = "Write one question that the context answers, and its answer.\n\nOutput:::\nQuestion: (your question)\nAnswer: (your answer to the question)"
CRITIQUES = {
    "groundedness": "Rate from 1 to 5 how clearly the context answers the question.\n\nAnswer:::\nEvaluation: (your reasons)\nTotal rating: (1 to 5)",
    "relevance": "Rate from 1 to 5 how useful the question is to an expert reader.\n\nAnswer:::\nEvaluation: (your reasons)\nTotal rating: (1 to 5)",
    "standalone": "Rate from 1 to 5 how well the question makes sense by itself.\n\nAnswer:::\nEvaluation: (your reasons)\nTotal rating: (1 to 5)",
}
JUDGE = "Compare the response with the reference answer and rate it from 1 to 5.\nInstruction: {instruction}\nResponse: {response}\nReference: {reference}\nFeedback, then [RESULT] and the rating:"
MIN_RATING = 2


def context_text(rows: DataFrame, key: str, order: str, text: str, label: str = "Context") -> DataFrame:
    """``(key, context)``: the rows' cleaned texts, numbered from 1 in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), context_clean(F.coalesce(F.col(text), F.lit(""))).alias("t"))))
    g = rows.groupBy(key).agg(items.alias("items"))
    line = lambda x, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(": "), x["t"], F.lit(" \n"))
    return g.select(key, F.concat(F.lit(" "), F.array_join(F.transform("items", line), "")).alias("context"))


def stuff_documents(pages: Column) -> Column:
    """A list of page texts as one context: each between line ends (null texts are empty)."""
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit("\n"), F.coalesce(p, F.lit("")), F.lit("\n"))), "")


def chat_prompt(system: str | Column, user: Column) -> Column:
    """Two messages: the system's and the user's."""
    system = F.lit(system) if isinstance(system, str) else system
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", system), message("user", user))


def answer_prompt(context: Column, question: Column) -> Column:
    return chat_prompt(ANSWER_SYSTEM, F.concat(F.lit("Context: "), context, F.lit("\nQuestion: "), question))


def extract_prompt(contexts: Column, question: Column) -> Column:
    """The prompt that asks for an answer found in the contexts, or for none."""
    return chat_prompt(f"{ANSWER_SYSTEM}\n{EXTRACT_TASK}", F.concat(F.lit("Question: "), question, F.lit("\n\nContexts: "), contexts))


def critique_prompt(kind: str, question: Column, context: Column | None = None) -> Column:
    body = F.concat(F.lit("Question: "), question)
    if context is not None:
        body = F.when(context.isNull(), body).otherwise(F.concat(body, F.lit("\nContext: "), context))
    return chat_prompt(CRITIQUES[kind], body)


def fill(template: str, **values: Column) -> Column:
    """A template's ``{slots}`` filled with columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _after(text: Column, mark: str) -> Column:
    """What stands between the first and the second ``mark``; null without any."""
    return F.try_element_at(F.split(text, "\\Q" + mark + "\\E", -1), F.lit(2))


def parse_qa(completion: Column) -> tuple[Column, Column]:
    """Question (to the line's end) and answer; null where its mark is missing."""
    question = F.split_part(_after(completion, "Question: "), F.lit("\n"), F.lit(1))
    return question, _after(completion, "Answer: ")


def parse_critique(completion: Column, finish_reason: Column) -> tuple[Column, Column]:
    """Score and reasons of a critique that ended by itself; "0" and empty otherwise."""
    done = finish_reason == "stop"
    score = F.trim(F.split_part(_after(completion, "Total rating: "), F.lit("\n"), F.lit(1)))
    reason = F.split_part(_after(completion, "Evaluation: "), F.lit("\n"), F.lit(1))
    return F.when(done, score).otherwise(F.lit("0")), F.when(done, reason).otherwise(F.lit(""))


def parse_judge(completion: Column) -> Column:
    """The text after the last ``[RESULT]``, stripped; "0" without a completion."""
    return F.coalesce(F.trim(F.element_at(F.split(completion, "\\[RESULT\\]", -1), -1)), F.lit("0"))


def judge_reasons(completion: Column) -> Column:
    """What a judge wrote for people to read: from the prompt's end mark to the rating's, stripped; null without the first."""
    return F.trim(F.split_part(_after(completion, "[/INST]"), F.lit("[RESULT]"), F.lit(1)))


def passes_critiques(*scores: Column, least: float = MIN_RATING) -> Column:
    """All scores are numbers of ``least`` or more (what is missing or no number counts as 0)."""
    ok = F.lit(True)
    for s in scores:
        ok = ok & (F.coalesce(s.cast("string").try_cast("double"), F.lit(0.0)) >= least)
    return ok


def fits_window(text: Column, n_ctx: int) -> Column:
    """Whether a text has at most ``n_ctx`` words, the stand-in for model tokens."""
    return F.size(F.filter(F.split(text, "\\s+"), lambda w: w != "")) <= n_ctx


def generate(df: DataFrame, prompt: str, model: Callable[[str], str] | None = None, out: str = "completion") -> DataFrame:
    """Add ``out``: ``model`` of each prompt, in Arrow batches (offline default: the prompt's last line)."""
    model = model or (lambda p: p.rstrip("\n").rsplit("\n", 1)[-1])

    def scan(batches):
        for batch in batches:
            texts = [None if p is None else model(p) for p in batch.column(batch.schema.get_field_index(prompt)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(scan, df.withColumn(out, F.lit(None).cast("string")).schema)


def document_items(nodes: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """Context nodes with their distances: numbered in node order, then sorted by distance."""
    joined = paths.join(nodes, paths["node"] == nodes[key])
    numbered = joined.withColumn("doc_num", F.row_number().over(Window.partitionBy("source").orderBy(key)))
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("dist", "doc_num")))


def result_documents(nodes: DataFrame, paths: DataFrame, key: str, text: str, description: str, date: str, path: str) -> DataFrame:
    """``(source, place, page_content, metadata)``: context nodes by rising distance, as result items.

    ``doc_num`` counts in node order, before the sort; nulls of a node stay null in its metadata.
    """
    metadata = F.struct(
        "doc_num", "doc_description", "doc_date", F.col("dist").alias("doc_difference"), file_name(F.col("_path")).alias("title"),
    )
    told = nodes.select(F.col(key).alias("_node"), *[F.col(c).alias(n) for c, n in ((text, "page_content"), (description, "doc_description"), (date, "doc_date"), (path, "_path"))])
    return document_items(told, paths, "_node").select("source", "place", "page_content", metadata.alias("metadata"))


def run_cases(nodes: DataFrame, edges: DataFrame, cases: DataFrame, key: str, text: str, name: str, k: int = 3, model: Callable[[str], str] | None = None, pick: str = "last") -> DataFrame:
    """``(case_id, question, anchor_document, node_id, context, answer)`` of all test cases.

    A case is anchored in the best node of its document, or of all documents where it names none.  A
    case whose document has no nodes has no answer (null).  ``nodes`` hold their vectors as ``embedding``.
    """
    asked = materialize(embed_queries(cases.select("case_id", "question", "anchor_document"), "question", "_q"), "cases")
    score = F.round(dot(F.col("embedding"), F.col("_q")), 6)
    inside = nodes.join(asked, F.col(name) == F.col("anchor_document")).select(F.col("case_id").cast("long").alias("query_id"), F.col(key).cast("long").alias("node_id"), score.alias("score"))
    free = asked.where("anchor_document is null").select(F.col("case_id").alias(key), F.col("_q").alias("embedding"))
    scored = inside.union(vector_top_k(nodes, free, 1, key).select("query_id", "node_id", "score"))
    got = answer(nodes, edges, scored, asked.select(F.col("case_id").cast("long").alias("query_id"), "question"), key, text, k, model, pick)
    return cases.select("case_id", "question", "anchor_document").join(got.select(F.col("query_id").alias("case_id"), "node_id", "context", "answer"), "case_id", "left")


def answer(nodes: DataFrame, edges: DataFrame | VectorGraph, scored: DataFrame, questions: DataFrame, key: str, text: str, k: int = 3, model: Callable[[str], str] | None = None, pick: str = "last") -> DataFrame:
    """``(query_id, question, node_id, context, answer)`` for a batch of questions.

    ``scored`` holds each question's candidates ``(query_id, node_id, score)``; the best one is the
    anchor from which the graph is walked for ``k`` context nodes.
    """
    anchors = anchor_nodes(scored)
    sources = anchors.select(F.col("node_id").alias("source"))
    paths = vector_paths.context_nodes(edges, sources, k, pick) if isinstance(edges, VectorGraph) else context_nodes(shortest_paths(edges, sources), k, pick)
    context = context_text(document_items(nodes.select(F.col(key).alias("_node"), F.col(text).alias("_text")), paths, "_node"), "source", "place", "_text")
    rows = questions.join(anchors, "query_id").join(context, F.col("node_id") == F.col("source"), "left").drop("source", "score")
    prompt = F.array_join(F.transform(answer_prompt(F.coalesce("context", F.lit("")), F.col("question")), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return generate(rows.withColumn("prompt", prompt), "prompt", model, "answer").drop("prompt")


def anchor_filter(nodes: DataFrame, name: str, document: str | None) -> DataFrame:
    """Nodes of one document, where a document is chosen."""
    return nodes if document is None else nodes.where(F.col(name) == document)


def format_results(ranked: DataFrame, nodes: DataFrame, key: str, path: str) -> DataFrame:
    """One row a result: rank, score, document file; and the last node of each file as its metadata."""
    last = nodes.groupBy(file_name(F.col(path)).alias("document")).agg(F.max(key).alias("meta_node"))
    named = ranked.join(nodes.select(F.col(key).alias("node_id"), file_name(F.col(path)).alias("document")), "node_id")
    return named.join(last, "document").select("query_id", F.concat(F.lit("result_"), F.col("rank").cast("string")).alias("result"), "score", "document", "meta_node")


def evaluation_sheet(answers: DataFrame, contexts: Column, k: int, run: str) -> DataFrame:
    """Answers widened for human raters: a column per context item, and empty score columns."""
    cols = []
    for i in range(k):
        cols += [F.get(contexts, F.lit(i)).alias(f"context_{i}"), F.lit(None).cast("double").alias(f"context_{i}_score")]
    return answers.select("*", F.lit(None).cast("double").alias("output_score"), *cols, F.lit(run).alias("run"))
