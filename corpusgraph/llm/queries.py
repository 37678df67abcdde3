"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import (
    collocations, decontamination, html_extraction, line_dedup, packing, quality_rules, sharding, simhash, token_counts, toxicity, url_filters, warc, whitening,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(_read(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"), "fail_bits",
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filters.filter_urls(pages, url_filters.block_list(spark))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, sf_dir, "documents"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_read(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"))


def tokenizer_path() -> str:
    """The production vocabulary; a file of the installed package of public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = (
    op1_html_extraction, op2_line_dedup, op3_packing, op4_quality_rules, op5_url_filters, op6_sharding, op7_toxicity,
    op8_simhash_near_dedup, op9_benchmark_decontamination, op10_warc, op11_collocations, op12_embedding_whitening, op13_token_counts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_OP2 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, lines, len(list_filter(string_split_regex(lines[i + 1], '[\x20\x09-\x0D]+'), lambda v: v <> '')) AS w FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM d)),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM l),
b AS (SELECT *, after - w AS before FROM c),
x AS (SELECT *, max(i) OVER e AS e_i, max(after) OVER e AS e_after, min(i) OVER s AS s_i, min(before) OVER s AS s_before FROM b
      WINDOW e AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), s AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
r AS (SELECT DISTINCT doc_id, p, q, array_to_string(lines[p + 1:q + 1], chr(10)) AS run FROM (
      SELECT doc_id, lines, i AS p, e_i AS q FROM x WHERE e_after - before >= 50 UNION ALL SELECT doc_id, lines, s_i, i FROM x WHERE after - s_before >= 50)),
k AS (SELECT doc_id, p, q, row_number() OVER o AS nth, first_value(doc_id) OVER o AS doc0, first_value(p) OVER o AS p0 FROM r WINDOW o AS (PARTITION BY run ORDER BY doc_id, p)),
a AS (SELECT doc_id, CASE WHEN doc0 = doc_id THEN greatest(p, p0 + q - p + 1) ELSE p END AS p, q FROM k WHERE nth > 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(p, q + 1)))) AS gone FROM a WHERE p <= q GROUP BY doc_id)
SELECT o.doc_id, CASE WHEN gone IS NULL THEN o.text ELSE coalesce(array_to_string(list_filter(d.lines, lambda v, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text,
    coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_deleted
FROM documents o LEFT JOIN d USING (doc_id) LEFT JOIN g USING (doc_id)
"""

_OP4 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT rid, doc_id, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS words,
        list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, sum(least(8, i - p)) AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -100) AS p FROM d) GROUP BY rid),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(x, '[^!]', '', 'g'))::BIGINT AS n_bangs FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
        + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars > 20 * n_words OR word_chars < 2 * n_words)::BIGINT
        + 32 * (2 * n_bangs > n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

_OP5 = r"""
WITH h AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM h),
r AS (SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM s),
a AS (SELECT unnest([@LABELS@]) AS a), b AS (SELECT unnest([NULL, @COMPANIONS@]) AS b), d AS (SELECT unnest([@DOMAINS@]) AS d),
l AS (SELECT DISTINCT unnest([concat_ws('-', a, b), concat_ws('-', b, a)]) || '.' || d AS name FROM a, b, d),
n AS (SELECT DISTINCT host, array_to_string(string_split(host, '.')[i:], '.') AS name FROM (SELECT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM (SELECT DISTINCT host FROM r))),
m AS (SELECT DISTINCT host FROM n JOIN l USING (name))
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN m.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN m ON m.host = r.host
"""
for _name, _values in (("LABELS", url_filters.LISTED_LABELS), ("COMPANIONS", url_filters.COMPANIONS), ("DOMAINS", url_filters.DOMAINS)):
    _OP5 = _OP5.replace(f"@{_name}@", ", ".join(f"'{x}'" for x in _values))


_OP6 = r"""
WITH s0 AS (SELECT list_transform(range(256), lambda n: n::BIGINT) AS v),
@STEPS@,
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
b AS (SELECT rid, unnest(regexp_extract_all(hex(encode(x)), '..')) AS y, generate_subscripts(regexp_extract_all(hex(encode(x)), '..'), 1) AS i FROM d),
c AS (SELECT rid, list(('0x' || y)::BIGINT ORDER BY i) AS bytes FROM b GROUP BY rid),
k AS (SELECT d.rid, doc_id, octet_length(encode(x))::BIGINT + 16 AS size, ('0x' || substr(md5(x), 1, 15))::BIGINT AS h,
        xor(list_reduce(coalesce(bytes, []::BIGINT[]), lambda crc, byte: xor(crc >> 8, v[(xor(crc, byte) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32
      FROM d LEFT JOIN c USING (rid), s8),
r AS (SELECT *, (sum(size) OVER o - size)::BIGINT AS before, row_number() OVER o AS place, (sum(size) OVER ())::BIGINT AS total FROM k WINDOW o AS (ORDER BY h, doc_id NULLS FIRST, rid)),
g AS (SELECT *, min(before) OVER (PARTITION BY h) AS begun FROM r),
q AS (SELECT *, least(39, (CASE WHEN before - begun <= total * 5 // 4000 THEN begun ELSE before END) * 40 // total)::INTEGER AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM q
""".replace("@STEPS@", ",\n".join(f"s{i} AS (SELECT list_transform(v, lambda n: CASE WHEN n & 1 = 1 THEN xor(n >> 1, 3988292384) ELSE n >> 1 END) AS v FROM s{i - 1})" for i in range(1, 9)))

_OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, n, array_to_string(w[p:p + 9], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM v),
g AS (SELECT rid, p, n.n, array_to_string(w[p:p + n.n - 1], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d), n WHERE p + n.n - 1 <= len(w)),
h AS (SELECT rid, p, n, item FROM g JOIN v USING (n, g)),
x AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
y AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (rid) LEFT JOIN y USING (rid)
"""

_OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""


_OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT row_number() OVER () AS pid, lang, piece FROM (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
w AS (SELECT pid, lang, unnest(ws) AS w1, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT pid, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda v: v <> '') AS ws FROM p)),
s AS (SELECT lang, w1, lead(w1, 1) OVER e AS w2, lead(w1, 2) OVER e AS w3, lead(w1, 3) OVER e AS w4 FROM w WINDOW e AS (PARTITION BY pid ORDER BY i)),
f AS MATERIALIZED (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM s GROUP BY ALL
      UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
      UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM s WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
q AS MATERIALIZED (SELECT {'lang': lang, 'phrase': phrase} AS part, f FROM f),
u AS MATERIALIZED (SELECT lang, k, phrase, a, cut, {'lang': lang, 'phrase': array_to_string(ws[1:cut], ' ')} AS head, {'lang': lang, 'phrase': array_to_string(ws[cut + 1:], ' ')} AS tail
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
v AS (SELECT u.*, h.f AS l, t.f AS r, (2000000::HUGEINT * u.a) // (h.f::HUGEINT + t.f::HUGEINT) AS score FROM u JOIN q h ON h.part = u.head JOIN q t ON t.part = u.tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM v) WHERE nth = 1),
x AS (SELECT lang, a AS f, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM c, range(1, 4) t(i), range(2, 4) z(m) WHERE m < k AND i + m - 1 <= k),
y AS (SELECT lang, phrase, max(f) AS f FROM x GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN y USING (lang, phrase) WHERE y.f IS NULL OR 100::HUGEINT * y.f < 80::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN n USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _OP2, "op4_quality_rules": _OP4, "op5_url_filters": _OP5, "op6_sharding": _OP6, "op9_benchmark_decontamination": _OP9, "op10_warc": _OP10, "op11_collocations": _OP11}
