"""Result items, test cases, images, metadata names and pair samples."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import metrics
from corpusgraph.operators import chat, embedding, rag, search, stats
from corpusgraph.sources import io


def test_result_items_number_in_node_order_and_sort_by_distance(spark):
    nodes = spark.createDataFrame([(1, "one", "x/a.pdf", None, "2020"), (2, "two", "b.pdf", "d", None), (3, None, None, "d", None)], "id long, source string, path string, descr string, day string")
    paths = spark.createDataFrame([(9, 1, 0.5), (9, 2, 0.2), (9, 3, 0.5)], "source long, node long, dist double")
    got = rag.result_documents(nodes, paths, "id", "source", "descr", "day", "path").orderBy("place").collect()
    assert [(r.page_content, r.metadata.doc_num, r.metadata.doc_difference, r.metadata.title) for r in got] == [("two", 2, 0.2, "b.pdf"), ("one", 1, 0.5, "a.pdf"), (None, 3, 0.5, None)]


def test_cases_are_anchored_in_their_document(spark):
    rows = [(0, "red apple", "a"), (1, "green pear", "a"), (2, "red apple pie", "b"), (3, "blue sky", "b")]
    nodes = embedding.embed(spark.createDataFrame(rows, "id long, text string, source string"), "text")
    edges = spark.createDataFrame([(0, 1, 0.4), (2, 3, 0.7)], "src long, dst long, weight double")
    cases = io.test_cases(spark, [("apple", "a"), ("sky", "b"), ("pear", None), ("apple", "none")])
    got = {r.case_id: r for r in rag.run_cases(nodes, edges, cases, "id", "text", "source", model=lambda p: "yes").collect()}
    assert [got[i].node_id for i in range(4)] == [0, 3, 1, None]
    assert "green pear" in got[0].context and "blue" not in got[0].context
    assert [got[i].answer for i in range(4)] == ["yes", "yes", "yes", None]


def test_prompts_and_ratings(spark):
    one = spark.createDataFrame([("x [/INST] so [RESULT] 5", "no mark", None)], "a string, b string, c string")
    got = one.select(rag.judge_reasons(F.col("a")), rag.judge_reasons(F.col("b")), rag.judge_reasons(F.col("c")), rag.stuff_documents(F.array("b", "c"))).first()
    assert tuple(got) == ("so", None, None, "\nno mark\n\n\n")


def test_images(spark):
    data = base64.b64encode(b"pixels").decode()
    rows = [(1, 0, "system", "be kind", None), (1, 1, "user", "look", [("url", "http://i", "png"), ("bytes", data, "jpeg")]), (1, 2, "assistant", "nice", None), (1, 3, "user", "and?", [("bytes", data, "jpeg")]), (1, 4, "assistant", None, None), (2, 0, "user", None, [])]
    c = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, images array<struct<kind:string,value:string,filetype:string>>")
    name = hashlib.md5(b"pixels").hexdigest()
    hashed = {(r.conv_id, r.turn): r.image_hashes for r in chat.hashed_turns(c).collect()}
    assert hashed[1, 1] == ["http://i", name] and hashed[1, 2] is None and hashed[2, 0] == []
    files = chat.image_files(c)
    assert [(r.path, bytes(r.data)) for r in files.collect()] == [(f"images/{name}.jpeg", b"pixels")]
    assert chat.image_files(c, saved=files).count() == 0
    got = {r[0]: json.loads(r[1]) for r in chat.vision_messages(c).select("conv_id", F.to_json("messages")).collect()}
    assert got[1] == [
        {"role": "system", "content": [{"type": "text", "text": "be kind"}]},
        {"role": "user", "content": [{"type": "text", "text": "look"}, {"type": "image_url", "image_url": {"url": "http://i"}}, {"type": "image_url", "image_url": {"url": "data:image/jpeg;base64," + data}}]},
        {"role": "assistant", "content": [{"type": "text", "text": "nice"}]},
        {"role": "user", "content": [{"type": "text", "text": "and?"}, {"type": "image_url", "image_url": {"url": "data:image/jpeg;base64," + data}}]},
    ]
    held = {r[0]: json.loads(r[1]) for r in chat.vision_messages(c, "anthropic").select("conv_id", F.to_json("messages")).collect()}
    assert held[1][3]["content"][1] == {"type": "image", "source": {"type": "base64", "media_type": "image/jpeg", "data": data}}
    assert held[2][0] == {"role": "system", "content": [{"type": "text", "text": ""}]}


def test_renamed_metadata(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert io.rename_metadata(df, {"a": "x"}, ["c"]).columns == ["x", "b"]
    with pytest.raises(ValueError):
        io.rename_metadata(df, {"nope": "x"})


def test_sampled_pairs(spark):
    df = spark.range(7).select((F.col("id") * 10).alias("n"))
    got = stats.sample_pairs(df, "n", 200).collect()
    assert len(got) == 200 and all(r.a != r.b for r in got) and len({(r.a, r.b) for r in got}) > 30
    assert stats.sample_pairs(df, "n", 200).collect() == got or sorted(stats.sample_pairs(df, "n", 200).collect()) == sorted(got)
    assert stats.sample_pairs(df.limit(1), "n").count() == 0


def test_scored_top_k_in_one_block_and_in_many(spark):
    class Near:
        columns = ["x"]

        def __call__(self, a, b):
            return -F.abs(F.col(a + "x") - F.col(b + "x"))

    df = spark.range(30).select("id", (F.col("id") * 7 % 30).cast("double").alias("x"))
    one = search.scored_top_k(df, df.where("id % 5 = 0"), Near(), "id", 3).collect()
    many = search.scored_top_k(df, df.where("id % 5 = 0"), Near(), "id", 3, block_rows=2).collect()
    x = {i: i * 7 % 30 for i in range(30)}
    want = sorted((q, n, r) for q in range(0, 30, 5) for r, n in enumerate(sorted((n for n in x if n != q), key=lambda n: (abs(x[n] - x[q]), n))[:3], 1))
    assert sorted((r.query_id, r.node_id, r["rank"]) for r in one) == want == sorted((r.query_id, r.node_id, r["rank"]) for r in many)


def test_fuzzy_items_in_the_metric_vector(spark):
    from corpusgraph import build
    vector = [1.0]
    rows = [(i, "n", vector, vector, vector, "Speech", ["Smith"], [t], ["b"], ["d"], 1, 1) for i, t in enumerate(["inflation", "inflations"])]
    nodes = spark.createDataFrame(rows, "id long, name string, name_emb array<double>, embedding array<double>, desc_emb array<double>, type string, authors array<string>, topics array<string>, brands array<string>, divisions array<string>, mpc_round int, forecast_round int").withColumn("date", F.lit("2020-01-01").cast("date"))
    r = build.metric_table(nodes, "id").first()
    assert r.topic == 1.0 and r.average == 1.0
    assert len(metrics.METRICS) == 11
