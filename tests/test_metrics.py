import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import metrics as M
from corpusgraph.functions import text as X
from corpusgraph.operators.scorers import MeanScorer


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("days", "want"), [(0, 1), (14, 1), (-14, 1), (-91, -1), (366, -1), (15, 0.993), (365, -0.333), (-90, 0.783)])
def test_date_score(spark, days, want):
    a, b = dt.date(2024, 1, 1) + dt.timedelta(days=days), dt.date(2024, 1, 1)
    assert one(spark, M.date_score(F.lit(a), F.lit(b))) == want
    assert one(spark, M.date_score(F.lit(None).cast("date"), F.lit(b))) is None


@pytest.mark.parametrize(("a", "b", "want"), [("Speech", "Speech", 1), ("Background Reading", "Recommended reading", 0.6), ("Speech", "Background Reading", 0.4), ("Data Response", "Background Reading", 0), ("Other", "Speech", 0)])
def test_type_score(spark, a, b, want):
    assert one(spark, M.type_score(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize(("a", "b", "want"), [("kitten", "sitting", 4), ("", "abc", 0), ("abc", "", 0), ("abc", "abc", 3), ("abcd", "dcba", 1)])
def test_lcs(spark, a, b, want):
    assert one(spark, M.lcs_length(F.lit(a), F.lit(b))) == want


def test_ratios(spark):
    assert round(one(spark, M.indel_ratio(F.lit("kitten"), F.lit("sitting"))), 4) == 0.6154
    assert one(spark, M.indel_ratio(F.lit(""), F.lit(""))) == 1
    assert one(spark, M.partial_ratio(F.lit("bcd"), F.lit("abcde"))) == 1
    assert one(spark, M.partial_ratio(F.lit(""), F.lit("abcde"))) == 0


def test_lists(spark):
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    assert one(spark, M.list_jaccard(arr(), arr())) == 0
    assert one(spark, M.list_jaccard(arr("a", "a", "b"), arr("a"))) == round(1 / 3, 3)
    assert one(spark, M.list_jaccard(arr("", "a"), arr("", "a"))) == round(1 / 3, 3)
    assert one(spark, M.list_score(arr("alpha"), arr("Alpa"), M.close_match())) == 1
    assert one(spark, M.brand_score(arr("x", "NaN"), arr("x"))) == 0
    assert one(spark, M.set_jaccard(arr(), arr())) == 0
    assert one(spark, M.equality_score(F.lit(None).cast("string"), F.lit(None).cast("string"))) == 1


def test_half_even_author_sets_and_close_lists(spark):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    many = [f"i{i}" for i in range(16)]
    assert one(spark, M.list_jaccard(arr(many), arr(["i0"]))) == 0.062
    assert one(spark, M.author_score(arr(["a", "a", "b"]), arr(["a", "b", "b"]))) == 1
    cols = {"name": F.lit("a"), "name_emb": F.array(F.lit(1.0)), "embedding": F.array(F.lit(1.0)), "desc_emb": F.array(F.lit(1.0)), "type": F.lit("Speech"), "brands": arr(["b"]), "divisions": arr(["d"]),
            "topics": arr(["t"]), "mpc_round": F.lit("m"), "forecast_round": F.lit("f"), "date": F.lit(dt.date(2024, 1, 1))}
    df = spark.range(1).select(*[c.alias(p + n) for p in ("a_", "b_") for n, c in cols.items()], arr(["Jane Smith"]).alias("a_authors"), arr(["Jane Smyth"]).alias("b_authors"))
    assert df.select(MeanScorer()("a_", "b_").alias("v")).first().v == 1


def test_weighted_score_of_ones(spark):
    assert one(spark, M.weighted_score([F.lit(1.0)] * 11)) == pytest.approx(1 / 11)
    assert one(spark, M.mean_score([F.lit(1.0)] * 11)) == 1


def test_metric_vector(spark):
    cols = {"name": F.lit("a"), "name_emb": F.array(F.lit(1.0)), "embedding": F.array(F.lit(0.5)), "desc_emb": F.array(F.lit(0.5)), "type": F.lit("Speech"), "authors": F.array(F.lit("x")),
            "topics": F.array(F.lit("t")), "brands": F.array(F.lit("nan")), "divisions": F.array(F.lit("d")), "mpc_round": F.lit("m"), "forecast_round": F.lit("f"), "date": F.lit(dt.date(2024, 1, 1))}
    df = spark.range(1).select(*[c.alias(p + n) for p in ("a_", "b_") for n, c in cols.items()])
    got = list(df.select(*[c.alias(n) for n, c in zip(M.METRICS, M.metric_vector(), strict=True)]).first())
    assert got == [1, 0.25, 0.25, 1, 1, 1, 0, 1, 1, 1, 1]


def test_text(spark):
    assert one(spark, X.split_list(F.lit("a>b|c,,"))) == ["a", "b", "c", "", ""]
    assert one(spark, X.base_name(F.lit("x/y.z.pdf"))) == "y" and one(spark, X.file_name(F.lit("x/y.z.pdf"))) == "y.z.pdf"
    assert one(spark, X.windows_name(F.lit("a\\b.pdf"))) == "b.pdf"
    assert one(spark, X.context_clean(F.lit(" a\n\tb   c "))) == "a b  c"
    assert one(spark, X.clean_text(F.lit("Été\nÀ  la\tFIN…"))) == "ete a la fin"
    assert one(spark, X.tokens(F.lit(" a b\n"))) == ["a", "b"] and one(spark, X.tokens(F.lit(""))) == []
    assert one(spark, X.parse_date(F.lit("03/02/2024"))) == dt.date(2024, 2, 3) == one(spark, X.parse_date(F.lit("2024-02-03")))
    assert one(spark, X.parse_date(F.lit("nan"))) is None
    assert one(spark, X.entities(F.lit("The Bank Rate at MPC in 2024 was 5.25"))) == ["The Bank Rate", "MPC", "2024", "5.25"]


def test_entity_link_top_k_against_all_rows(spark, sf):
    import __spark_entry__ as entry
    from corpusgraph.functions import metrics, text
    from corpusgraph.operators import scorers

    rows = [(0, ["A", "B", "A"], ["x"]), (7, ["B"], ["x", "y"]), (50, ["A", "B"], []), (90, [], ["x"]), (91, ["Z"], ["z"]), (92, None, None)]
    df = spark.createDataFrame(rows, "id long, e array<string>, l array<string>")
    got = scorers.entity_link_top_k(df, df.where("id % 100 = 0"), F.col("e"), F.col("l"), "id").orderBy("rank").collect()
    assert [(r.node_id, r.score, r.rank) for r in got] == [(50, 0.8, 1), (7, 0.5, 2), (90, 0.2, 3)]

    p = spark.read.parquet(f"{sf}/pages.parquet").where("page_id is not null").select("page_id", text.entities(F.regexp_replace("html", "<[^>]*>", " ")).alias("e"), text.links(F.col("html")).alias("l"))
    score = F.round(metrics.entity_link_score(F.col("a.e"), F.col("b.e"), F.col("a.l"), F.col("b.l")), 6)
    pairs = p.alias("a").where("page_id % 100 = 0").join(p.alias("b"), F.col("a.page_id") != F.col("b.page_id")).select(F.col("a.page_id").alias("q"), F.col("b.page_id").alias("n"), score.alias("s")).where("s > 0").collect()
    want = {(q, r.n, r.s) for q in {r.q for r in pairs} for r in sorted((r for r in pairs if r.q == q), key=lambda r: (-r.s, r.n))[:5]}
    assert want and {(r.query_id, r.node_id, r.score) for r in entry.queries()["entity_link_topk"](spark, sf).collect()} == want
