"""Block searches against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpusgraph.operators import pairs, scorers, search


def best(scores, k):
    """``{(query, rank): (node, score)}`` from ``{query: {node: score}}``."""
    out = {}
    for q, found in scores.items():
        for r, (node, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out[q, r] = (node, s)
    return out


def found(df):
    return {(r["query_id"], r["rank"]): (r["node_id"], r["score"]) for r in df.collect()}


def sets(seed, n=120):
    rng = random.Random(seed)
    return {i: {f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randint(0, 9))} for i in range(n)}


def half_up(x):
    return math.floor(x * 1e6 + 0.5) / 1e6


def test_sets_in_one_block_and_in_many(spark):
    have = sets(1)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in have.items()] + [(None, ["w1"]), (500, None), (501, [None, "w1"])], "id long, s0 array<string>").repartition(3)
    everything = {**{i: set(s) for i, s in have.items()}, 500: set(), 501: {None, "w1"}}
    want = best({
        q: {n: half_up(len((a & b) - {None}) / len(a | b)) for n, b in everything.items() if n != q and (a & b) - {None}} for q, a in have.items() if q % 10 == 0
    }, 5)
    asked = df.where("id % 10 = 0 and id < 500")
    score = lambda both, a, b: search.share(both[0], a[0], b[0])
    assert found(search.sparse_top_k(df, asked, 1, score, 5)) == want
    assert found(search.sparse_top_k(df, asked, 1, score, 5, limit=1500)) == want  # three queries a block


def test_entities_and_links(spark):
    e, l = sets(2, 60), sets(3, 60)
    df = spark.createDataFrame([(i, sorted(e[i]), sorted(l[i])) for i in e], "id long, e array<string>, l array<string>")
    j = lambda a, b: len(a & b) / max(len(a | b), 1)
    want = best({q: {n: half_up(0.8 * j(e[q], e[n]) + 0.2 * j(l[q], l[n])) for n in e if n != q and (e[q] & e[n] or l[q] & l[n])} for q in e if q % 10 == 0}, 4)
    assert found(scorers.entity_link_top_k(df, df.where("id % 10 = 0"), F.col("e"), F.col("l"), "id", 4)) == want


def test_relevance_of_repeated_words_and_empty_texts(spark):
    docs = {0: "a a b", 1: "a c c c", 2: "d", 3: None, 4: "", 5: "b b b b"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    words = {i: (t or "").split() for i, t in docs.items()}
    avg, n = sum(map(len, words.values())) / 6, 6
    df_of = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    idf = {w: math.log((n - c + 0.5) / (c + 0.5)) for w, c in df_of.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    gain = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = best({
        q: {i: half_up(sum((idf[w] if idf[w] >= 0 else floor) * gain(words[i].count(w), len(words[i])) for w in words[q])) for i in words if set(words[i]) & set(words[q])}
        for q in words if words[q]
    }, 3)
    assert found(scorers.bm25_top_k(df, df, 3)) == want


def test_vectors_in_many_blocks(spark):
    rng = np.random.default_rng(0)
    m = np.round(rng.normal(size=(90, 4)), 1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(90, None), (None, [0.0] * 4)], "vec_id long, embedding array<double>")
    want = best({q: {i: float(s) for i, s in enumerate(np.round(m @ m[q], 6))} for q in range(0, 90, 9)}, 5)
    got = found(pairs.vector_top_k(df, df.where("vec_id % 9 = 0 or vec_id = 90"), 5, block_rows=3))
    assert {x: y[0] for x, y in got.items()} == {x: y[0] for x, y in want.items()}


def test_no_queries_and_no_rows(spark):
    df = spark.createDataFrame([(1, ["a"])], "id long, s array<string>")
    none = df.where("id < 0")
    assert scorers.jaccard_top_k(df, none, F.col("s"), "id").count() == 0
    assert scorers.jaccard_top_k(none, df, F.col("s"), "id").count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scorers.bm25_top_k(docs, docs).count() == 0


def test_thresholds_in_blocks_equal_those_of_written_pairs(spark, monkeypatch):
    from corpusgraph.operators import tuning

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 3)))] + [(40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 16)
    want = [tuple(r) for r in tuning.threshold_table(pairs.all_pairs(df)).orderBy("idx").collect()]
    assert [tuple(r) for r in tuning.product_threshold_table(df, "vec_id").orderBy("idx").collect()] == want
    assert tuning.product_threshold_table(df.limit(1), "vec_id").count() == 0


def test_sets_meet_in_tiles_and_are_made_once(spark, monkeypatch):
    """Common and rare items, ties and queries of several tiles and blocks; however many blocks, a row's set is made once."""
    for name, value in {"TILE_ROWS": 16, "FIRST_ROWS": 4, "TILE_QUERIES": 3, "COMMON_LEAST": 2, "COMMON_SHARE": 0.3, "COMMON_MOST": 6}.items():
        monkeypatch.setattr(search, name, value, raising=False)
    have = sets(4, 200) | {300 + i: {"w1", "w2", f"only{i % 7}"} for i in range(20)}
    made = spark.sparkContext.accumulator(0)

    def make(text):
        made.add(1)
        return text.split()

    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in have.items()], "id long, s string").repartition(3)
    df = df.select("id", F.udf(make, "array<string>").asNondeterministic()("s").alias("s0"))
    want = best({q: {n: half_up(len(a & b) / len(a | b)) for n, b in have.items() if n != q and a & b} for q, a in have.items() if q % 10 == 0}, 5)
    score = lambda both, a, b: search.share(both[0], a[0], b[0])
    assert found(search.sparse_top_k(df, df.where("id % 10 = 0"), 1, score, 5, limit=2000)) == want  # six blocks or so
    assert made.value <= 2 * len(have)
