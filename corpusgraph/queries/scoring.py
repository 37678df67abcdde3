"""Full metric scorers, small-graph statistics, result items, prompts and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph import build
from corpusgraph.functions import metrics, text
from corpusgraph.operators import analytics, chat, embedding, graph, pairs, rag, scorers, search, stats, vector_paths
from corpusgraph.queries import read
from corpusgraph.queries.graphs import _DIST, _graph
from corpusgraph.queries.tables import _TYPES, _date, _ratio
from corpusgraph.sources import io

_TYPE_NAMES = sorted({*metrics.DOC_TYPES, *(t for row in metrics.DOC_TYPES.values() for t in row)})


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with all descriptions that the metrics compare; names and list items are of one or
    two characters, where the spelling ratio of different ones is below any threshold and SQL can follow."""
    n, v = F.col("vec_id"), F.col("embedding")
    item = lambda c: c.cast("string")
    return read(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").select(
        n, (n % 10).cast("string").alias("name"), v.alias("name_emb"), v, F.reverse(v).alias("desc_emb"),
        F.get(F.array(*map(F.lit, _TYPE_NAMES)), (n % len(_TYPE_NAMES)).cast("int")).alias("type"), F.array(item(F.col("label")), item(n % 3)).alias("authors"),
        F.array(item(n % 5), item(n % 2)).alias("topics"), F.array(F.when(n % 10 == 0, F.lit("nan")).otherwise(item(n % 4))).alias("brands"), F.array(item(n % 6)).alias("divisions"),
        (n % 8).alias("mpc_round"), (n % 4).alias("forecast_round"), F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int")).alias("date"),
    )


def metric_vector_pairs(spark, sf_dir):
    """All metrics of all pairs of nations (each with the vector of its number), and their mean."""
    nations = _described(spark, sf_dir).join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vec_id")), "vec_id")
    t = build.metric_table(nations, "vec_id")
    return t.select(F.col("a_vec_id").alias("src"), F.col("b_vec_id").alias("dst"), *metrics.METRICS, F.round("average", 6).alias("average"))


def mean_score_topk(spark, sf_dir):
    n = _described(spark, sf_dir)
    return search.scored_top_k(n, n.where("vec_id % 100 = 0"), scorers.MeanScorer(), "vec_id")


def weighted_score_topk(spark, sf_dir):
    n = _described(spark, sf_dir)
    return search.scored_top_k(n, n.where("vec_id % 100 = 0"), scorers.WeightedScorer(), "vec_id")


def spelled_score_topk(spark, sf_dir):
    """The mean score with the names of parts, and their words with a digit as authors and topics, so that spelling counts."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("part_name"))
    words = F.transform(F.split("part_name", " "), lambda w: F.concat(w, (F.col("vec_id") % 3).cast("string")))
    n = _described(spark, sf_dir).join(p, "vec_id").withColumns({"name": F.col("part_name"), "authors": words, "topics": words}).drop("part_name")
    return search.scored_top_k(n, n.where("vec_id % 100 = 0"), scorers.MeanScorer(), "vec_id")


def query_topk(spark, sf_dir):
    """Each benchmark text as a question to all documents."""
    docs = embedding.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    asked = embedding.embed_queries(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "text")
    return pairs.vector_top_k(docs, asked, 5, "doc_id")


def _nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, linked within their region."""
    n = read(spark, sf_dir, "nation")
    e = n.select(F.col("n_nationkey").alias("src"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("dst"), "n_regionkey"), "n_regionkey")
    return n, e.where("src < dst").select("src", "dst", F.lit(1.0).alias("weight"))


def greedy_communities(spark, sf_dir):
    return analytics.greedy_communities(*_nation_graph(spark, sf_dir), "n_nationkey")


def connectivity(spark, sf_dir):
    got = analytics.connectivity(*_nation_graph(spark, sf_dir), "n_nationkey")
    return spark.createDataFrame([(float(got["avg_node_connectivity"]), int(got["node_connectivity"]), int(got["edge_connectivity"]))], "avg_node_connectivity double, node_connectivity long, edge_connectivity long")


def renamed_metadata(spark, sf_dir):
    return io.rename_metadata(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), {"n_nationkey": "id", "n_name": "title"}, ["n_regionkey"])


def sampled_pair_hist(spark, sf_dir):
    """A thousand random pairs of vectors by their product, in steps of a tenth."""
    v = read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    drawn = stats.sample_pairs(v, "vec_id")
    both = drawn.join(v.toDF("a", "x"), "a").join(v.toDF("b", "y"), "b")
    return stats.value_histogram(both.select(F.round(metrics.dot(F.col("x"), F.col("y")), 6).alias("w")), "w", 0.1)


def extract_prompts(spark, sf_dir):
    """One prompt a source: all its documents, and a question."""
    d = read(spark, sf_dir, "benchmark")
    m = rag.extract_prompt(rag.stuff_documents(F.array("text", F.concat(F.lit("!"), "text"))), F.lit("Why?"))
    return d.select("item_id", F.md5(m[1]["content"]).alias("digest"))


def rating_texts(spark, sf_dir):
    """The reasons in a judge's completion, made of a prompt, the item's text and a rating."""
    said = F.concat(F.lit("[INST] rate [/INST]\n "), F.col("text"), F.lit(" [RESULT] 4"))
    b = read(spark, sf_dir, "benchmark").select("item_id", said.alias("said"))
    return b.select("item_id", F.md5(rag.judge_reasons(F.col("said"))).alias("digest"), rag.parse_judge(F.col("said")).alias("rating"))


def result_items(spark, sf_dir):
    """The context nodes of each hundredth vector as result items."""
    g = _graph(spark, sf_dir)
    nodes, paths = g.nodes, vector_paths.context_nodes(g, g.nodes.where("vec_id % 100 = 0").select("vec_id"), 10, "first")
    told = nodes.select("vec_id", F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), F.col("label").cast("string").alias("description"), F.lit("2020-01-01").alias("date"), F.concat(F.lit("a/b/"), F.col("label").cast("string")).alias("path"))
    r = rag.result_documents(told, paths, "vec_id", "text", "description", "date", "path")
    return r.select("source", "place", "page_content", "metadata.doc_num", "metadata.doc_description", "metadata.doc_date", "metadata.doc_difference", "metadata.title")


def run_cases(spark, sf_dir):
    """Cases anchored in regions, in no document and in one that isn't there, answered through the graph of nations."""
    n, e = _nation_graph(spark, sf_dir)
    n = embedding.embed(n.select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("source")), "n_name")
    cases = io.test_cases(spark, [("Which nation is CHINA?", d) for d in ("0", "2", None, "nowhere")])
    return rag.run_cases(n, e, cases, "n_nationkey", "n_name", "source").select("case_id", "anchor_document", "node_id", "context")


def vision_renders(spark, sf_dir):
    """Conversations with an image in each third turn, as message lists of two services."""
    c = read(spark, sf_dir, "conversations")
    image = F.array(F.struct(F.when(F.col("turn") % 2 == 0, F.lit("url")).otherwise(F.lit("bytes")).alias("kind"), F.base64(F.col("text").cast("binary")).alias("value"), F.lit("png").alias("filetype")))
    c = c.withColumn("images", F.when(F.col("turn") % 3 == 0, image))
    digest = lambda s: F.md5(F.to_json("messages")).alias(s)
    a, b = chat.vision_messages(c), chat.vision_messages(c, "anthropic")
    return a.select("conv_id", digest("openai")).join(b.select("conv_id", digest("anthropic")), "conv_id")


def author_items(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_authors(F.replace(F.col("p_name"), F.lit(" "), F.lit(" , "))), "/").alias("authors"))


def desc_scores(spark, sf_dir):
    """Each vector's description metric with the next one."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(w, "vec_id").select("vec_id", metrics.text_score(F.col("embedding"), F.col("other")).alias("score"))


QUERIES = (
    metric_vector_pairs, mean_score_topk, weighted_score_topk, spelled_score_topk, query_topk, greedy_communities, connectivity, renamed_metadata, sampled_pair_hist, extract_prompts, rating_texts,
    result_items, run_cases, vision_renders, author_items, desc_scores,
)


def _overlap(c: str) -> str:
    common = f"len(list_distinct(list_filter(a.{c}, lambda x: list_contains(b.{c}, x))))"
    return f"round_even(2 * round_even(least(1.0, {common} / (len(a.{c}) + len(b.{c}) - {common})), 3) - 1, 3)"


_SAME = "CASE WHEN a.{0} = b.{0} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
_DOT = "list_inner_product(a.{0}::DOUBLE[], b.{0}::DOUBLE[])"
_VECTORS = f"""g(t, u, d) AS (VALUES {_TYPES}),
n AS (SELECT vec_id, (vec_id % 10)::VARCHAR AS name, embedding, list_reverse(embedding) AS desc_emb, ({_TYPE_NAMES})[vec_id % {len(_TYPE_NAMES)} + 1] AS type,
    list_distinct([label::VARCHAR, (vec_id % 3)::VARCHAR]) AS authors, [(vec_id % 5)::VARCHAR, (vec_id % 2)::VARCHAR] AS topics, CASE WHEN vec_id % 10 = 0 THEN 'nan' ELSE (vec_id % 4)::VARCHAR END AS brand,
    [(vec_id % 6)::VARCHAR] AS divisions, vec_id % 8 AS mpc_round, vec_id % 4 AS forecast_round FROM embeddings),
v AS (SELECT a.vec_id AS src, b.vec_id AS dst, round_even(0.5 * {_SAME.format("name")} + 0.5 * {_DOT.format("embedding")}, 3) + 0.0 AS name, round_even({_DOT.format("embedding")}, 3) + 0.0 AS text, round_even({_DOT.format("desc_emb")}, 3) + 0.0 AS "desc",
    CASE WHEN a.type = b.type THEN 1.0::DOUBLE WHEN a.type IN (SELECT t FROM g) THEN coalesce(round(2 * (p.d - 0.5), 3), 0) ELSE coalesce(round(2 * (q.d - 0.5), 3), 0) END AS type,
    {_overlap("authors")} AS author, {_overlap("topics")} AS topic, CASE WHEN a.brand = 'nan' OR b.brand = 'nan' THEN 0.0::DOUBLE WHEN a.brand = b.brand THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS brand,
    {_overlap("divisions")} AS division, {_SAME.format("mpc_round")} AS mpc_round, {_SAME.format("forecast_round")} AS forecast_round, {_date("(a.vec_id - b.vec_id)", "365.0")} AS date
    FROM n a JOIN n b ON {{on}} LEFT JOIN g p ON p.t = a.type AND p.u = b.type LEFT JOIN g q ON q.t = b.type AND q.u = a.type)"""
_COLUMNS = [f'"{m}"' for m in metrics.METRICS]
_MEAN = f"({' + '.join(_COLUMNS)}) / {len(_COLUMNS)}"
_WEIGHTED = f"({' + '.join(f'{w} * {c}' for w, c in zip(metrics.WEIGHTS, _COLUMNS, strict=True))}) / {len(_COLUMNS)}"


def _best(score: str) -> str:
    return f"""WITH {_VECTORS.format(on="a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id")}, r AS (SELECT src AS query_id, dst AS node_id, round(({score})::DOUBLE, 6) AS score FROM v)
        SELECT query_id, node_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM r) WHERE rank <= 5"""


#: The name and the words of both rows as numbers of a table of spellings; all else as in ``_VECTORS``.
_SPELLED = f"""WITH p AS (SELECT vec_id, p_name, list_transform(string_split(p_name, ' '), lambda w: w || (vec_id % 3)) AS ws FROM embeddings JOIN part ON p_partkey = vec_id),
pn AS (SELECT DISTINCT p_name AS s FROM p), nr AS MATERIALIZED (SELECT a.s AS x, b.s AS y, {_ratio('a.s', 'b.s')} AS r FROM pn a, pn b),
pw AS (SELECT DISTINCT unnest(ws) AS s FROM p), wr AS MATERIALIZED (SELECT a.s AS x, b.s AS y FROM pw a, pw b WHERE {_ratio('lower(a.s)', 'lower(b.s)')} * 100 >= 80),
pl AS (SELECT DISTINCT ws FROM p), pe AS (SELECT ws, unnest(ws) AS w FROM pl),
pc AS (SELECT a.ws AS x, b.ws AS y, count(DISTINCT a.w) AS c FROM pe a JOIN wr ON wr.x = a.w JOIN pe b ON wr.y = b.w GROUP BY ALL),
lj AS MATERIALIZED (SELECT a.ws AS x, b.ws AS y, round_even(2 * round_even(least(1.0::DOUBLE, coalesce(c, 0)::DOUBLE / (len(a.ws) + len(b.ws) - coalesce(c, 0))), 3) - 1, 3) AS j FROM pl a CROSS JOIN pl b LEFT JOIN pc ON pc.x = a.ws AND pc.y = b.ws),
"""
_SPELLED_V = """, z AS (SELECT v.* REPLACE (round_even(0.5 * (2 * nr.r - 1) + 0.5 * (list_inner_product(e.embedding::DOUBLE[], f.embedding::DOUBLE[])), 3) + 0.0 AS name, lj.j AS author, lj.j AS topic)
    FROM v JOIN p a ON a.vec_id = src JOIN p b ON b.vec_id = dst JOIN nr ON nr.x = a.p_name AND nr.y = b.p_name JOIN lj ON lj.x = a.ws AND lj.y = b.ws JOIN embeddings e ON e.vec_id = src JOIN embeddings f ON f.vec_id = dst)"""


_DRAW = "('0x' || substr(md5('0:' || i || ':{0}'), 1, 8))::BIGINT"
_REGIONS = "WITH g AS (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1), n AS (SELECT count(*) AS n FROM nation)"

ORACLES = {
    "metric_vector_pairs": f"WITH {_VECTORS.format(on='a.vec_id < b.vec_id AND b.vec_id IN (SELECT n_nationkey FROM nation) AND a.vec_id IN (SELECT n_nationkey FROM nation)')} SELECT src, dst, {', '.join(_COLUMNS)}, round({_MEAN}, 6) AS average FROM v",
    "mean_score_topk": _best(_MEAN),
    "weighted_score_topk": _best(_WEIGHTED),
    "spelled_score_topk": _best(_MEAN).replace("WITH ", _SPELLED, 1).replace(", r AS (", _SPELLED_V + ", r AS (", 1).replace("AS score FROM v)", "AS score FROM z)", 1),
    "greedy_communities": "SELECT n_nationkey AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS community FROM nation",
    "connectivity": f"{_REGIONS} SELECT round(sum(c * (c - 1) / 2 * (c - 1)) / (max(n) * (max(n) - 1) / 2), 6) AS avg_node_connectivity, 0::BIGINT AS node_connectivity, 0::BIGINT AS edge_connectivity FROM g, n",
    "renamed_metadata": "SELECT n_nationkey AS id, n_name AS title FROM nation",
    "sampled_pair_hist": f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding FROM embeddings), z AS (SELECT count(*) AS n FROM v),
        d AS (SELECT n, {_DRAW.format("a")} % n AS a, {_DRAW.format("b")} AS b FROM range(1000) r(i), z), p AS (SELECT a, (a + 1 + b % (n - 1)) % n AS b FROM d)
        SELECT floor(round(list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) / 0.1::DOUBLE)::BIGINT AS bucket, count(*) AS n FROM p JOIN v x ON x.i = p.a JOIN v y ON y.i = p.b GROUP BY 1""",
    "extract_prompts": "SELECT item_id, md5('Question: Why?' || chr(10) || chr(10) || 'Contexts: ' || chr(10) || text || chr(10) || chr(10) || '!' || text || chr(10)) AS digest FROM benchmark",
    "rating_texts": "SELECT item_id, md5(trim(chr(10) || ' ' || text || ' ', ' ')) AS digest, '4' AS rating FROM benchmark",
    "result_items": f"""WITH {_DIST}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dist, node) AS o FROM d) WHERE o <= 10),
        i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY node) AS doc_num FROM c)
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY dist, doc_num)::INT AS place, 'text ' || node AS page_content, doc_num::INT AS doc_num, label::VARCHAR AS doc_description,
        '2020-01-01' AS doc_date, dist AS doc_difference, label::VARCHAR AS title FROM i JOIN embeddings ON vec_id = node""",
    "author_items": "SELECT p_partkey, replace(p_name, ' ', '/') AS authors FROM part",
    "desc_scores": f"SELECT a.vec_id, round_even({_DOT.format('embedding')}, 3) + 0.0 AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
