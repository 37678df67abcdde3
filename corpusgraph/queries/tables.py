"""Pair metrics and statistics on relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions import metrics, text
from corpusgraph.operators import fuzzy, pairs, rag, scorers, stats
from corpusgraph.plans.percentiles import percentiles
from corpusgraph.plans.scratch import materialize
from corpusgraph.queries import read
from corpusgraph.sources import io


def _next_order(spark, sf_dir):
    """Every order beside its customer's next one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders")
    return o.withColumn("next_date", F.lead("o_orderdate").over(w)).withColumn("next_priority", F.lead("o_orderpriority").over(w)).where("next_date is not null")


def _next_part(spark, sf_dir):
    """Every part beside the part of the next number."""
    p = read(spark, sf_dir, "part")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("q_type"), F.col("p_name").alias("q_name"), F.col("p_brand").alias("q_brand"))
    return p.join(q, "p_partkey")


def date_score_pairs(spark, sf_dir):
    return _next_order(spark, sf_dir).select("o_orderkey", metrics.date_score(F.col("o_orderdate"), F.col("next_date")).alias("score"))


def date_score_wide(spark, sf_dir):
    """The date metric with another span."""
    return _next_order(spark, sf_dir).select("o_orderkey", metrics.date_score(F.col("next_date"), F.col("o_orderdate"), 360.0).alias("score"))


def equality_score(spark, sf_dir):
    return _next_order(spark, sf_dir).select("o_orderkey", metrics.equality_score(F.col("o_orderpriority"), F.col("next_priority")).alias("score"))


def type_score_pairs(spark, sf_dir):
    """All ordered pairs of the table's types and one unknown."""
    names = sorted({*metrics.DOC_TYPES, *(t for row in metrics.DOC_TYPES.values() for t in row), "Other"})
    t = spark.createDataFrame([(n,) for n in names], "a string")
    return t.crossJoin(t.withColumnRenamed("a", "b")).withColumn("score", metrics.type_score(F.col("a"), F.col("b")))


def exact_list_jaccard(spark, sf_dir):
    s = lambda c: F.split(F.col(c), " ")
    return _next_part(spark, sf_dir).select("p_partkey", metrics.list_jaccard(s("p_type"), s("q_type")).alias("jaccard"), metrics.list_score(s("p_name"), s("q_name")).alias("score"))


def brand_nan_rule(spark, sf_dir):
    brand = lambda c: F.array(F.when(F.col("p_partkey") % 10 == 0, F.lit("nan")).otherwise(F.col(c)))
    return _next_part(spark, sf_dir).select("p_partkey", metrics.brand_score(brand("p_brand"), brand("q_brand")).alias("score"))


def fuzzy_list_scores(spark, sf_dir):
    s = lambda c: F.split(F.col(c), " ")
    return _next_part(spark, sf_dir).select("p_partkey", metrics.list_score(s("p_name"), s("q_name"), metrics.close_match()).alias("score"))


def name_ratio(spark, sf_dir):
    return _next_part(spark, sf_dir).select("p_partkey", F.round(metrics.indel_ratio(F.col("p_name"), F.col("q_name")), 6).alias("ratio"))


def matched_names(spark, sf_dir):
    """The region name spelled most like each nation's."""
    return scorers.best_match(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"), "n_name", "r_name")


def matched_part_names(spark, sf_dir):
    """The part name spelled most like each part name turned round."""
    p = read(spark, sf_dir, "part")
    turned = p.select(F.array_join(F.reverse(F.split("p_name", " ")), " ").alias("turned"))
    return scorers.best_match(turned, p, "turned", "p_name", 0.2)


def close_part_names(spark, sf_dir):
    """All pairs of part names with a spelling ratio of 0.7 or more."""
    p = read(spark, sf_dir, "part")
    return fuzzy.close_pairs(p, p, "p_name", "p_name", 0.7).select("x", "y", F.round("ratio", 6).alias("ratio"))


def fuzzy_list_join(spark, sf_dir):
    """Brands by the words of their parts' names, each with the brand's last digit: pairs that share words spelled alike."""
    p = read(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("word")).where("word is not null")
    lists = p.groupBy("p_brand").agg(F.sort_array(F.collect_set(F.concat(F.upper(F.substring("word", 1, 2)), F.substring("word", 3, 20), F.substring("p_brand", -1, 1)))).alias("words"))
    return fuzzy.fuzzy_list_pairs(lists, lists, "p_brand", "words")


def split_types(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", text.split_list(F.replace(F.col("p_type"), F.lit(" "), F.lit(" > "))).alias("items"))
    return p.select("p_partkey", F.size("items").alias("n"), F.array_join("items", "/").alias("joined"))


def distinct_type_words(spark, sf_dir):
    return stats.distinct_values(read(spark, sf_dir, "part"), F.split("p_type", " "))


def order_epochs(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.epoch_seconds(F.col("o_orderdate")).alias("date_num"))


def stringified_metadata(spark, sf_dir):
    n = io.attach_metadata(read(spark, sf_dir, "nation").withColumn("region", F.col("n_regionkey").cast("string")), read(spark, sf_dir, "region"), "region", "r_regionkey")
    return n.select("n_name", "meta_r_name", "meta_r_regionkey")


def half_even_rounding(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 1).alias("r"))


def robust_scale_by_run(spark, sf_dir):
    e = scorers.robust_scale(read(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("scaled"), 5).alias("lo"), F.round(F.max("scaled"), 5).alias("hi"))


def weight_quartiles_by_run(spark, sf_dir):
    e = percentiles(read(spark, sf_dir, "events"), "value", [0.25, 0.5, 0.75], ["event_type"])
    return e.select("event_type", *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(3)])


def metric_describe(spark, sf_dir):
    return stats.describe(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def metric_corr(spark, sf_dir):
    return stats.correlations(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def table_profile(spark, sf_dir):
    return stats.profile(read(spark, sf_dir, "nation"))


def metric_regressions(spark, sf_dir):
    r = stats.leave_one_out_regressions(read(spark, sf_dir, "part"), ["p_size", "p_retailprice"], "p_partkey")
    return r.select("target", *[F.round(c, 4).alias(c) for c in r.columns if c != "target"])


def principal_scores(spark, sf_dir):
    e = materialize(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), "vectors")
    return scorers.principal_score(e, ["l_quantity", "l_discount", "l_tax"], 2).select("l_orderkey", "l_linenumber", F.round("weight", 6).alias("weight"))


def type_pairs(spark, sf_dir):
    """Theta self-join of nations on a user-defined scorer: shared region."""
    same = lambda a, b: metrics.equality_score(F.col(a + "n_regionkey"), F.col(b + "n_regionkey"))
    return pairs.theta_pairs(read(spark, sf_dir, "nation"), "n_nationkey", same, ["n_regionkey"]).select("a_n_nationkey", "b_n_nationkey", "weight")


def qa_filter(spark, sf_dir):
    """Labels as critique scores: both of 1 or more."""
    return read(spark, sf_dir, "labels").where(rag.passes_critiques(F.col("quality"), F.lit(1) - F.col("toxic"), least=1)).select("doc_id")


QUERIES = (
    date_score_pairs, date_score_wide, equality_score, type_score_pairs, exact_list_jaccard, brand_nan_rule, fuzzy_list_scores, name_ratio, matched_names, matched_part_names, close_part_names, fuzzy_list_join, split_types, distinct_type_words,
    order_epochs, stringified_metadata, half_even_rounding, robust_scale_by_run, weight_quartiles_by_run, metric_describe, metric_corr, table_profile, metric_regressions, principal_scores,
    type_pairs, qa_filter,
)

_NEXT = """n AS (SELECT *, lead(o_orderdate) OVER w AS nd, lead(o_orderpriority) OVER w AS np FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def _date(diff: str, span: str) -> str:
    return f"CASE WHEN {diff} < -90 OR {diff} > 365 THEN -1.0::DOUBLE WHEN {diff} > -15 AND {diff} < 15 THEN 1.0::DOUBLE ELSE round(1 / (0.5 + ({diff} / {span}) * ({diff} / {span})) - 1, 3) END"


def _lists(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


_TYPES = ", ".join(f"('{a}', '{b}', {d}::DOUBLE)" for a, row in metrics.DOC_TYPES.items() for b, d in row.items())
_PART = "FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"
_STAT = "SELECT '{0}' AS \"column\", count({0}) AS count, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, round(min({0}), 6) AS min, round(quantile_cont({0}, 0.25), 6) AS q25, round(quantile_cont({0}, 0.5), 6) AS q50, round(quantile_cont({0}, 0.75), 6) AS q75, round(max({0}), 6) AS max FROM lineitem"


def _ratio(a: str, b: str) -> str:
    """Twice the longest common subsequence over both lengths, row by row of the programme's table."""
    numbers = lambda x, i: f"list_transform(range(1, length({x}) + 1), lambda {i}: [{i}::INT])"
    cell = f"CASE WHEN {a}[i[1]] = {b}[j[1]] THEN row_[j[1]] + 1 ELSE greatest(row_[j[1] + 1], acc[-1]) END"
    row = f"list_reduce({numbers(b, 'v')}, lambda acc, j: list_append(acc, {cell}), [0::INT])"
    table = f"list_reduce({numbers(a, 'u')}, lambda row_, i: {row}, list_resize([0::INT], length({b}) + 1, 0::INT))"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0::DOUBLE * {table}[-1] / (length({a}) + length({b})) END"


_MATCHED = f"""WITH k AS MATERIALIZED (SELECT *, regexp_replace(name, '[^a-zA-Z0-9]', '', 'g') AS x, regexp_replace(match, '[^a-zA-Z0-9]', '', 'g') AS y FROM (@K@)),
        o AS (SELECT *, lower(x) AS lx, lower(y) AS ly, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS sh, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS lo FROM k),
        z AS (SELECT name, match, sh, substr(lo, i::INT, length(sh)::INT) AS part FROM (SELECT *, unnest(range(1, length(lo) - length(sh) + 2)) AS i FROM o)),
        b AS (SELECT name, match, max({_ratio('sh', 'part')}) AS best FROM z GROUP BY 1, 2),
        s AS (SELECT name, match, round(0.4 * {_ratio('x', 'y')} + 0.3 * best + 0.3 * {_ratio('lx', 'ly')}, 6) AS score FROM o JOIN b USING (name, match))
        SELECT name, match, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, length(match), match) AS r FROM s WHERE score > @LOW@) WHERE r = 1
        UNION ALL SELECT DISTINCT name, '', -1.0 FROM k WHERE name NOT IN (SELECT name FROM s WHERE score > @LOW@)"""


_REGRESSION = """SELECT '{0}' AS target, round(avg(a), 4) AS mape_mean, round(stddev_pop(a), 4) AS mape_std, round(avg(b), 4) AS mse_mean, round(stddev_pop(b), 4) AS mse_std FROM
    (SELECT f.fold, avg(abs(g.k + g.s * f.{1} - f.{0}) / abs(f.{0})) AS a, avg((g.k + g.s * f.{1} - f.{0}) ** 2) AS b
    FROM f JOIN (SELECT o.fold, regr_slope(f.{0}, f.{1}) AS s, regr_intercept(f.{0}, f.{1}) AS k FROM f JOIN (SELECT DISTINCT fold FROM f) o ON f.fold <> o.fold GROUP BY 1) g ON g.fold = f.fold GROUP BY f.fold)"""
_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

ORACLES = {
    "date_score_pairs": f"WITH {_NEXT}, d AS (SELECT o_orderkey, date_diff('day', nd::DATE, o_orderdate::DATE) AS d FROM n WHERE nd IS NOT NULL) SELECT o_orderkey, {_date('d', '365.0')} AS score FROM d",
    "date_score_wide": f"WITH {_NEXT}, d AS (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, nd::DATE) AS d FROM n WHERE nd IS NOT NULL) SELECT o_orderkey, {_date('d', '360.0')} AS score FROM d",
    "equality_score": f"WITH {_NEXT} SELECT o_orderkey, CASE WHEN o_orderpriority IS NOT DISTINCT FROM np THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM n WHERE nd IS NOT NULL",
    "type_score_pairs": f"""WITH g(a, b, d) AS (VALUES {_TYPES}), t AS (SELECT a AS t FROM g UNION SELECT b FROM g UNION SELECT 'Other')
        SELECT x.t AS a, y.t AS b, CASE WHEN x.t = y.t THEN 1.0::DOUBLE WHEN x.t IN (SELECT a FROM g) THEN coalesce(round(2 * (p.d - 0.5), 3), 0) ELSE coalesce(round(2 * (q.d - 0.5), 3), 0) END AS score
        FROM t x CROSS JOIN t y LEFT JOIN g p ON p.a = x.t AND p.b = y.t LEFT JOIN g q ON q.a = y.t AND q.b = x.t""",
    "exact_list_jaccard": f"""SELECT a.p_partkey, round({_lists("string_split(a.p_type, ' ')", "string_split(b.p_type, ' ')")}, 3) AS jaccard,
        round(2 * round({_lists("string_split(a.p_name, ' ')", "string_split(b.p_name, ' ')")}, 3) - 1, 3) AS score {_PART}""",
    "name_ratio": f"SELECT p_partkey, round({_ratio('x', 'y')}, 6) AS ratio FROM (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y {_PART})",
    "fuzzy_list_scores": f"""WITH p AS (SELECT a.p_partkey, string_split(a.p_name, ' ') AS x, string_split(b.p_name, ' ') AS y {_PART}),
        u AS (SELECT DISTINCT p_partkey, unnest(x) AS x FROM p), v AS (SELECT p_partkey, unnest(y) AS y FROM p), w AS (SELECT DISTINCT lower(x) AS x, lower(y) AS y FROM u JOIN v USING (p_partkey)),
        m AS (SELECT x, y FROM w WHERE {_ratio('x', 'y')} * 100 >= 80),
        c AS (SELECT p_partkey, count(DISTINCT u.x) AS c FROM u JOIN v USING (p_partkey) JOIN m ON m.x = lower(u.x) AND m.y = lower(v.y) WHERE trim(u.x) <> '' GROUP BY 1)
        SELECT p_partkey, round_even(2 * round_even(least(1.0::DOUBLE, coalesce(coalesce(c, 0)::DOUBLE / nullif(len(x) + len(y) - coalesce(c, 0), 0), 0)), 3) - 1, 3) AS score FROM p LEFT JOIN c USING (p_partkey)""",
    "matched_names": _MATCHED.replace("@K@", "SELECT DISTINCT n_name AS name, r_name AS match FROM nation, region").replace("@LOW@", "0"),
    "matched_part_names": _MATCHED.replace("@K@", "SELECT * FROM (SELECT DISTINCT array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS name FROM part), (SELECT DISTINCT p_name AS match FROM part)").replace("@LOW@", "0.2"),
    "close_part_names": f"""WITH p AS (SELECT DISTINCT p_name AS s FROM part), r AS (SELECT a.s AS x, b.s AS y, {_ratio('a.s', 'b.s')} AS ratio FROM p a, p b) SELECT x, y, round(ratio, 6) AS ratio FROM r WHERE ratio >= 0.7 - 1e-12""",
    "fuzzy_list_join": f"""WITH p AS (SELECT DISTINCT p_brand AS k, upper(substr(w, 1, 2)) || substr(w, 3, 20) || right(p_brand, 1) AS w FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)),
        d AS (SELECT DISTINCT lower(w) AS s FROM p), m AS MATERIALIZED (SELECT a.s AS x, b.s AS y FROM d a, d b WHERE {_ratio('a.s', 'b.s')} >= 0.8 - 1e-12), n AS (SELECT k, count(*) AS n FROM p GROUP BY k),
        c AS (SELECT a.k AS a, b.k AS b, count(DISTINCT a.w) AS common FROM p a JOIN m ON m.x = lower(a.w) JOIN p b ON m.y = lower(b.w) GROUP BY ALL)
        SELECT a, b, common, round_even(common::DOUBLE / (u.n + v.n - common), 3) AS jaccard FROM c JOIN n u ON u.k = a JOIN n v ON v.k = b""",
    "brand_nan_rule": f"SELECT a.p_partkey, CASE WHEN a.p_partkey % 10 = 0 THEN 0.0::DOUBLE WHEN a.p_brand = b.p_brand THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score {_PART}",
    "split_types": "SELECT p_partkey, len(string_split(p_type, ' '))::INT AS n, replace(p_type, ' ', '/') AS joined FROM part",
    "distinct_type_words": "SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS value FROM part) GROUP BY value",
    "order_epochs": "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS date_num FROM orders",
    "stringified_metadata": "SELECT n_name, r_name AS meta_r_name, r_regionkey::VARCHAR AS meta_r_regionkey FROM nation LEFT JOIN region ON r_regionkey = n_regionkey",
    "half_even_rounding": "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS r FROM lineitem",
    "robust_scale_by_run": """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events GROUP BY 1)
        SELECT event_type, count(*) AS n, round(min((value - b) / (c - a)), 5) AS lo, round(max((value - b) / (c - a)), 5) AS hi FROM events JOIN q USING (event_type) GROUP BY 1""",
    "weight_quartiles_by_run": "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q2 FROM events GROUP BY 1",
    "metric_describe": " UNION ALL ".join(_STAT.format(c) for c in _COLS),
    "metric_regressions": f"""WITH f AS (SELECT p_size::DOUBLE AS p_size, p_retailprice::DOUBLE AS p_retailprice, floor((row_number() OVER (ORDER BY p_partkey) - 1) * 5 / (count(*) OVER ())) AS fold FROM part)
        {_REGRESSION.format("p_size", "p_retailprice")} UNION ALL {_REGRESSION.format("p_retailprice", "p_size")}""",
    "metric_corr": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i:]),
    "table_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", min({c})::VARCHAR AS smallest, max({c})::VARCHAR AS largest FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")),
    "type_pairs": "SELECT a.n_nationkey AS a_n_nationkey, b.n_nationkey AS b_n_nationkey, CASE WHEN a.n_regionkey = b.n_regionkey THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "qa_filter": "SELECT doc_id FROM labels WHERE quality >= 1 AND toxic = 0",
}
