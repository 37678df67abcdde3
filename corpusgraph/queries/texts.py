"""Text preparation, chunking, token relevance and set overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import metrics, text
from corpusgraph.operators import chunking, embedding, rag, scorers, stats
from corpusgraph.queries import read
from corpusgraph.sources import io


def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("digest"))


def context_clean(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.context_clean(F.col("text"))).alias("digest"))


def path_names(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", text.file_name(url).alias("file"), text.base_name(url).alias("base"), text.windows_name(F.replace(url, F.lit("/"), F.lit("\\"))).alias("windows"))


def squeezed_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.squeeze(F.col("p_name")).alias("name"))


def word_counts(spark, sf_dir):
    """Words of each document (white space of any kind)."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"))


def doc_length_hist(spark, sf_dir):
    return stats.length_histogram(read(spark, sf_dir, "documents"), "text")


def distinct_docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count_distinct("text").alias("texts"), F.count_distinct("source").alias("sources"))


def md5_sample(spark, sf_dir):
    return stats.hash_sample(read(spark, sf_dir, "documents"), "doc_id", 10).select("doc_id")


def word_chunks(spark, sf_dir):
    w = chunking.word_windows(read(spark, sf_dir, "documents"), "doc_id", text.tokens(F.col("text")))
    return w.select("doc_id", "chunk_no", F.md5("chunk").alias("digest"))


def token_chunks(spark, sf_dir):
    return chunking.chunk_documents(read(spark, sf_dir, "documents"))


def limited_files(spark, sf_dir):
    """Documents of the first three sources."""
    return io.limit_files(read(spark, sf_dir, "documents"), "source", 3).groupBy("source").agg(F.count("*").alias("n"))


def page_links(spark, sf_dir):
    return io.extract_links(read(spark, sf_dir, "pages"))


def link_jaccard_pages(spark, sf_dir):
    p = read(spark, sf_dir, "pages").where("page_id is not null")
    return scorers.jaccard_top_k(p, p.where("page_id % 100 = 0"), text.links(F.col("html")), "page_id")


def link_character_overlap(spark, sf_dir):
    """Compatibility form of link overlap: characters of the written list, each page against the next."""
    p = read(spark, sf_dir, "pages").select("page_id", F.array_distinct(F.filter(F.split(F.array_join(text.links(F.col("html")), ","), ""), lambda c: c != "")).alias("s"))
    q = p.select((F.col("page_id") - 1).alias("page_id"), F.col("s").alias("t"))
    return p.join(q, "page_id").select("page_id", F.round(metrics.set_jaccard(F.col("s"), F.col("t")), 6).alias("score"))


def token_jaccard_topk(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return scorers.jaccard_top_k(d, d.where("doc_id % 100 = 0"), text.tokens(F.col("text")), "doc_id")


def bm25_topk(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return scorers.bm25_top_k(d, d.where("doc_id % 100 = 0")).select("query_id", "node_id", F.round("score", 4).alias("score"), "rank")


def entity_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.entities(F.col("text"))).alias("n"))


def entity_link_pairs(spark, sf_dir):
    """Each document against the next, on entities alone."""
    d = read(spark, sf_dir, "documents").select("doc_id", text.entities(F.col("text")).alias("e"))
    q = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("e").alias("f"))
    none = F.array().cast("array<string>")
    return d.join(q, "doc_id").select("doc_id", F.round(metrics.entity_link_score(F.col("e"), F.col("f"), none, none), 6).alias("score"))


def entity_link_topk(spark, sf_dir):
    """Each hundredth page against all pages, on the entities of its text and on its links."""
    p = read(spark, sf_dir, "pages").where("page_id is not null")
    body = F.regexp_replace("html", "<[^>]*>", " ")
    return scorers.entity_link_top_k(p, p.where("page_id % 100 = 0"), text.entities(body), text.links(F.col("html")), "page_id")


def embedded_documents(spark, sf_dir):
    e = embedding.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return e.select("doc_id", F.size("embedding").alias("dims"), F.round(metrics.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


def context_prompt(spark, sf_dir):
    """One context of all documents of a source."""
    c = rag.context_text(read(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return c.select("source", F.md5("context").alias("digest"))


def answer_prompts(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", rag.answer_prompt(text.context_clean(F.col("text")), F.lit("What is it about?")).alias("m")).select("item_id", F.size("m").alias("n"), F.md5(F.col("m")[1]["content"]).alias("digest"))


def critique_prompts(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    context = F.when(F.col("item_id") % 2 == 0, F.col("text"))
    m = rag.critique_prompt("relevance", F.lit("Q?"), context)
    return b.select("item_id", F.md5(m[1]["content"]).alias("digest"))


def window_fit(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(rag.fits_window(F.col("text"), 512).alias("fits")).agg(F.count("*").alias("n"))


QUERIES = (
    clean_text, context_clean, path_names, squeezed_names, word_counts, doc_length_hist, distinct_docs, md5_sample, word_chunks, token_chunks, limited_files, page_links,
    link_jaccard_pages, link_character_overlap, token_jaccard_topk, bm25_topk, entity_counts, entity_link_pairs, entity_link_topk, embedded_documents, context_prompt, answer_prompts,
    critique_prompts, window_fit,
)

_TOK = r"list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')"
_CLEAN = "trim(replace(replace(replace(text, chr(10), ' '), chr(9), ' '), '  ', ' '))"


def _jaccard(table: str, key: str, items: str) -> str:
    return f"""WITH s AS (SELECT {key} AS id, list_distinct({items}) AS s FROM {table}), x AS (SELECT id, len(s) AS n, unnest(s) AS item FROM s),
        c AS (SELECT a.id AS query_id, b.id AS node_id, a.n AS qn, b.n AS n, count(*) AS k FROM x a JOIN x b ON a.item = b.item AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY ALL),
        r AS (SELECT query_id, node_id, round(k / (qn + n - k), 6) AS score FROM c)
        SELECT query_id, node_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM r) WHERE rank <= 5"""


ORACLES = {
    "clean_text": rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(translate(regexp_replace(text, '[\r\n]', ' ', 'g'), '{text.ACCENTED}', '{text.PLAIN}')), '[^\x00-\x7F]', '', 'g'), '[ \t\x0B\f]+', ' ', 'g'))) AS digest FROM documents""",
    "context_clean": f"SELECT doc_id, md5({_CLEAN}) AS digest FROM documents",
    "path_names": "SELECT page_id, string_split(url, '/')[-1] AS file, split_part(string_split(url, '/')[-1], '.', 1) AS base, string_split(url, '/')[-1] AS windows FROM pages",
    "squeezed_names": "SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g') AS name FROM part",
    "word_counts": f"SELECT doc_id, len({_TOK})::INT AS n FROM documents",
    "doc_length_hist": "SELECT (floor(length(text) / 1000) * 1000)::BIGINT AS bucket, count(*) AS n FROM documents GROUP BY 1",
    "distinct_docs": "SELECT count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents",
    "md5_sample": "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 10",
    "word_chunks": f"""WITH w AS (SELECT doc_id, {_TOK} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 25) / 231)::INT))) AS chunk_no FROM w)
        SELECT doc_id, chunk_no::INT AS chunk_no, md5(array_to_string(w[chunk_no * 231 + 1:chunk_no * 231 + 256], ' ')) AS digest FROM c""",
    "limited_files": "SELECT source, count(*) AS n FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 3) GROUP BY source",
    "page_links": """SELECT page_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""",
    "link_jaccard_pages": _jaccard("pages", "page_id", """regexp_extract_all(html, 'href="([^"]*)"', 1)"""),
    "link_character_overlap": """WITH s AS (SELECT page_id, list_distinct(list_filter(string_split(array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ','), ''), lambda c: c <> '')) AS s FROM pages)
        SELECT a.page_id, coalesce(round(len(list_intersect(a.s, b.s)) / nullif(len(list_distinct(list_concat(a.s, b.s))), 0), 6), 0) AS score FROM s a JOIN s b ON b.page_id = a.page_id + 1""",
    "token_jaccard_topk": _jaccard("documents", "doc_id", _TOK),
    "bm25_topk": f"""WITH d AS (SELECT doc_id AS id, {_TOK} AS ts FROM documents), t AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS token FROM d) GROUP BY ALL),
        z AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d), f AS (SELECT token, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, z GROUP BY token, n),
        i AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM f) ELSE idf END AS idf FROM f),
        r AS (SELECT q.id AS query_id, t.id AS node_id, round(sum(q.tf * (idf * t.tf * 2.5 / (t.tf + 1.5 * (1 - 0.75 + 0.75 * t.dl / avgdl)))), 6) AS score FROM t JOIN i USING (token) JOIN t q ON q.token = t.token, z WHERE q.id % 100 = 0 GROUP BY 1, 2)
        SELECT query_id, node_id, round(score, 4) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM r) WHERE rank <= 5""",
    "entity_counts": r"SELECT doc_id, len(list_distinct(regexp_extract_all(replace(text, chr(10), ' '), '([A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z]{2,}|[0-9]+(?:\.[0-9]+)?)', 1)))::INT AS n FROM documents",
    "entity_link_pairs": r"""WITH s AS (SELECT doc_id, list_distinct(regexp_extract_all(replace(text, chr(10), ' '), '([A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z]{2,}|[0-9]+(?:\.[0-9]+)?)', 1)) AS s FROM documents)
        SELECT a.doc_id, coalesce(round(0.8 * (len(list_intersect(a.s, b.s)) / nullif(len(list_distinct(list_concat(a.s, b.s))), 0)), 6), 0) AS score FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""",
    "entity_link_topk": r"""WITH p AS (SELECT page_id AS id, list_distinct(regexp_extract_all(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), chr(10), ' '), '([A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z]{2,}|[0-9]+(?:\.[0-9]+)?)', 1)) AS e,
        list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS l FROM pages WHERE page_id IS NOT NULL),
        c AS (SELECT a.id AS query_id, b.id AS node_id, len(list_intersect(a.e, b.e)) AS e, len(list_intersect(a.l, b.l)) AS l, len(a.e) AS ae, len(b.e) AS be, len(a.l) AS al, len(b.l) AS bl FROM p a JOIN p b ON a.id <> b.id WHERE a.id % 100 = 0),
        r AS (SELECT query_id, node_id, round(0.8::DOUBLE * (e / greatest(ae + be - e, 1)) + 0.2::DOUBLE * (l / greatest(al + bl - l, 1)), 6) AS score FROM c WHERE e + l > 0)
        SELECT query_id, node_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM r) WHERE rank <= 5""",
    "context_prompt": f"""SELECT source, md5(' ' || string_agg('Context ' || o || ': ' || t || ' ' || chr(10), '' ORDER BY o)) AS digest FROM
        (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o, {_CLEAN} AS t FROM documents) GROUP BY source""",
    "answer_prompts": f"SELECT item_id, 2 AS n, md5('Context: ' || {_CLEAN} || chr(10) || 'Question: What is it about?') AS digest FROM benchmark",
    "critique_prompts": "SELECT item_id, md5('Question: Q?' || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'Context: ' || text ELSE '' END) AS digest FROM benchmark",
    "window_fit": f"SELECT len({_TOK}) <= 512 AS fits, count(*) AS n FROM documents GROUP BY 1",
}
