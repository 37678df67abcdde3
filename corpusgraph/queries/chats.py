"""Chat rendering, message lists, and parsing of model outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import chat, graph, pairs, rag, vector_graph
from corpusgraph.queries import read


def _render(spark, sf_dir, template):
    return chat.render(read(spark, sf_dir, "conversations"), template).select("conv_id", F.md5("prompt").alias("digest"), F.length("prompt").alias("n"))


def chatml_render(spark, sf_dir):
    return _render(spark, sf_dir, "chatml")


def llama2_render(spark, sf_dir):
    return _render(spark, sf_dir, "mistral")


def two_sep_render(spark, sf_dir):
    return _render(spark, sf_dir, "vicuna_v1.1")


def colon_render(spark, sf_dir):
    return _render(spark, sf_dir, "zero_shot")


def all_style_renders(spark, sf_dir):
    """Characters of all conversations' prompts in every style (its first template)."""
    first = {t.style: t.name for t in reversed(chat.TEMPLATES.values())}
    g = chat.gather(read(spark, sf_dir, "conversations"))
    rows = [F.struct(F.lit(style).alias("style"), F.count("*").alias("n"), F.sum(F.length(chat.prompt_of(name))).alias("chars")) for style, name in sorted(first.items())]
    return g.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("x")).select("x.*")


def openai_messages(spark, sf_dir):
    m = chat.openai_messages(read(spark, sf_dir, "conversations"))
    flat = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|")
    return m.select("conv_id", F.size("messages").alias("n"), F.md5(flat).alias("digest"))


def gemini_messages(spark, sf_dir):
    m = chat.service_messages(read(spark, sf_dir, "conversations"), "gemini")
    return m.select("conv_id", F.size("messages").alias("n"), F.element_at("messages", -1)["role"].alias("last_role"))


def turn_pairs(spark, sf_dir):
    p = chat.turn_pairs(read(spark, sf_dir, "conversations"))
    return p.select("conv_id", "pair_no", F.md5("user").alias("user"), F.md5("assistant").alias("assistant"))


def updated_conversations(spark, sf_dir):
    """A turn appended, the last one then changed, and the system text set."""
    c = chat.set_system_message(read(spark, sf_dir, "conversations"), "Be brief.")
    c = chat.update_last_message(chat.append_message(c, "assistant", None), "Done.")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "Done.").alias("done"), F.count_if(F.col("role") == "system").alias("systems"))


def parse_qa(spark, sf_dir):
    """Benchmark texts inside a completion that asks and answers."""
    done = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Output:::\nQuestion: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("?\nAnswer: "), F.col("item_id").cast("string")))
    q, a = rag.parse_qa(done)
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(q).alias("question"), a.alias("answer")).where("question is not null and answer is not null")


def parse_rating(spark, sf_dir):
    c = F.concat(F.lit("Evaluation: clear\nTotal rating: "), (F.col("item_id") % 6).cast("string"), F.lit("\n"))
    score, reason = rag.parse_critique(c, F.when(F.col("item_id") % 5 == 0, "length").otherwise("stop"))
    return read(spark, sf_dir, "benchmark").select("item_id", score.alias("score"), reason.alias("reason"), rag.passes_critiques(score).alias("kept"))


def parse_judge(spark, sf_dir):
    c = F.concat(rag.fill(rag.JUDGE, instruction=F.col("text"), response=F.lit("r"), reference=F.lit("[RESULT] 9")), F.lit(" good [RESULT] "), (F.col("item_id") % 5 + 1).cast("string"))
    return read(spark, sf_dir, "benchmark").select("item_id", rag.parse_judge(c).alias("score"))


def answers(spark, sf_dir):
    """Every hundredth document of ``embeddings`` as a question, answered by the offline default."""
    nodes = read(spark, sf_dir, "embeddings").withColumn("text", F.concat(F.lit("node "), F.col("vec_id").cast("string")))
    edges = vector_graph.VectorGraph(nodes, 0.25)
    asked = nodes.where("vec_id % 100 = 0")
    scored = pairs.vector_top_k(nodes, asked, 3).where("query_id <> node_id")
    return rag.answer(nodes, edges, scored, asked.select(F.col("vec_id").alias("query_id"), F.lit("what?").alias("question")), "vec_id", "text")


def formatted_results(spark, sf_dir):
    nodes = read(spark, sf_dir, "embeddings").withColumn("file", F.concat(F.lit("docs/"), F.col("label").cast("string"), F.lit(".pdf")))
    return rag.format_results(pairs.vector_top_k(nodes, nodes.where("vec_id % 100 = 0"), 3), nodes, "vec_id", "file")


def document_list(spark, sf_dir):
    return graph.document_names(read(spark, sf_dir, "documents"), "source")


def evaluation_sheet(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("turn").cast("string"), 4, "0"), F.col("role")))).alias("parts"))
    return rag.evaluation_sheet(c, F.col("parts"), 2, "run0").drop("parts")


QUERIES = (
    chatml_render, llama2_render, two_sep_render, colon_render, all_style_renders, openai_messages, gemini_messages, turn_pairs, updated_conversations, parse_qa, parse_rating, parse_judge,
    answers, formatted_results, document_list, evaluation_sheet,
)

_C = """s AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id),
m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations WHERE role IS DISTINCT FROM 'system'),
k AS (SELECT DISTINCT conv_id FROM conversations)"""


def _sql(system: str, said: str, unsaid: str) -> str:
    return f"""WITH {_C}, b AS (SELECT conv_id, string_agg(CASE WHEN coalesce(text, '') = '' THEN {unsaid} ELSE {said} END, '' ORDER BY i) AS body FROM m GROUP BY conv_id),
    p AS (SELECT k.conv_id, {system} || coalesce(body, '') AS prompt FROM k LEFT JOIN s USING (conv_id) LEFT JOIN b USING (conv_id))
    SELECT conv_id, md5(prompt) AS digest, length(prompt)::INT AS n FROM p"""


def _role(t: str) -> str:
    a, b = chat.get_template(t).roles
    return f"(CASE WHEN role = 'user' THEN '{a}' ELSE '{b}' END)"


def _system(t: str) -> str:
    return "'" + chat.get_template(t).system_message.replace("'", "''") + "'"


ORACLES = {
    "chatml_render": _sql("'<|im_start|>system' || chr(10) || coalesce(system, '') || '<|im_end|>' || chr(10)", f"{_role('chatml')} || chr(10) || text || '<|im_end|>' || chr(10)", f"{_role('chatml')} || chr(10)"),
    "llama2_render": _sql("CASE WHEN coalesce(system, '') = '' THEN '[INST] ' ELSE '[INST] ' || system || chr(10) END",
        "CASE WHEN i = 0 THEN text || ' ' WHEN i % 2 = 0 THEN '[INST] ' || text || ' ' ELSE '[/INST] ' || text || '</s>' END", "CASE WHEN i % 2 = 0 THEN '[INST]' ELSE '[/INST]' END"),
    "two_sep_render": _sql(f"coalesce(system, {_system('vicuna_v1.1')}) || ' '", f"{_role('vicuna_v1.1')} || ': ' || text || CASE WHEN i % 2 = 0 THEN ' ' ELSE '</s>' END", f"{_role('vicuna_v1.1')} || ':'"),
    "colon_render": _sql(f"coalesce(system, {_system('zero_shot')}) || chr(10) || '### '", f"{_role('zero_shot')} || ': ' || text || chr(10) || '### '", f"{_role('zero_shot')} || ':'"),
    "openai_messages": f"""WITH {_C}, x AS (SELECT conv_id, -1 AS i, 'system=' || system AS t FROM s WHERE system <> '' UNION ALL SELECT conv_id, i, CASE WHEN i % 2 = 0 THEN 'user=' ELSE 'assistant=' END || text FROM m)
        SELECT conv_id, count(*)::INT AS n, md5(string_agg(t, '|' ORDER BY i)) AS digest FROM x GROUP BY conv_id""",
    "gemini_messages": f"WITH {_C} SELECT conv_id, count(*)::INT AS n, CASE WHEN count(*) % 2 = 1 THEN 'user' ELSE 'model' END AS last_role FROM m GROUP BY conv_id",
    "turn_pairs": f"WITH {_C} SELECT a.conv_id, (a.i // 2)::INT AS pair_no, md5(a.text) AS user, md5(b.text) AS assistant FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.i = a.i + 1 WHERE a.i % 2 = 0",
    "updated_conversations": "SELECT conv_id, count(*) FILTER (role IS DISTINCT FROM 'system') + 2 AS n, 1::BIGINT AS done, 1::BIGINT AS systems FROM conversations GROUP BY conv_id",
    "parse_qa": "SELECT item_id, md5(replace(text, chr(10), ' ') || '?') AS question, item_id::VARCHAR AS answer FROM benchmark WHERE item_id % 3 <> 0",
    "parse_rating": """SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '0' ELSE (item_id % 6)::VARCHAR END AS score, CASE WHEN item_id % 5 = 0 THEN '' ELSE 'clear' END AS reason,
        item_id % 5 <> 0 AND item_id % 6 >= 2 AS kept FROM benchmark""",
    "parse_judge": "SELECT item_id, (item_id % 5 + 1)::VARCHAR AS score FROM benchmark",
    "document_list": "SELECT DISTINCT source FROM documents",
    "formatted_results": """WITH r AS (SELECT a.vec_id AS query_id, b.vec_id AS node_id, b.label, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS o FROM r)
        SELECT query_id, 'result_' || o AS result, score, o.label || '.pdf' AS document, m AS meta_node FROM o JOIN (SELECT label, max(vec_id) AS m FROM embeddings GROUP BY label) x ON x.label = o.label WHERE o <= 3""",
}
