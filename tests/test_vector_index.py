import numpy as np

from corpusgraph.operators import pairs, vector_index as V


def table(spark, m, extra=()):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def clustered(n, dims=8, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims)) * 3
    return np.round(centre[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.2, 3)


ODD = [(None, [0.0] * 8), (9001, None), (9002, [float("nan")] + [0.0] * 7), (9003, [None] + [0.0] * 7)]


def test_top_k_is_exact_and_skips_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_ROWS", 7)
    m = clustered(900)
    m[300:600] = m[0]  # a third of all rows alike
    df = table(spark, m, ODD)
    path = V.build(df, block_rows=16)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg({"n": "sum"}).first()[0] == len(m) and blocks.agg({"n": "max"}).first()[0] <= 16
    asked = df.where("vec_id % 20 = 0 or vec_id is null or vec_id > 9000")
    got = {}
    for r in V.index_top_k(path, asked, 7).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.node_id, r["rank"]))
    for q in range(0, len(m), 20):
        want = sorted((-float(V.half_up(m[q] @ x)), i) for i, x in enumerate(m))[:7]
        assert [x[:2] for x in sorted(got.pop(q), key=lambda x: x[2])] == want
    assert not got
    seen = V.looks(path, asked, 7).first()
    assert seen.looked < seen.queries * seen.blocks / 2


def test_pairs_over_a_threshold_are_those_of_all_pairs(spark):
    m = clustered(300, seed=1)
    df = table(spark, m, ODD[:2])
    path = V.build(df, block_rows=20)
    for low in (40.0, 5.0, -1e9):
        got = sorted(map(tuple, V.index_pairs(path, spark, low).collect()))
        want = sorted(map(tuple, pairs.all_pairs(df, min_weight=low).collect()))
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    blocks, d = spark.read.parquet(f"{path}/blocks"), spark.sparkContext.broadcast(V.directory(spark, path))
    n = blocks.count()
    assert V.block_pairs(blocks, d, 40.0).count() < n * (n + 1) / 4 and V.block_pairs(blocks, d, -1e9).count() == n * (n + 1) // 2


def test_few_and_no_rows(spark):
    df = table(spark, clustered(3))
    path = V.build(df)
    assert V.index_top_k(path, df, 10).count() == 9 and V.index_top_k(path, df, 10, itself=False).count() == 6
    empty = V.build(df.limit(0))
    assert V.index_top_k(empty, df, 2).count() == 0 and V.index_top_k(path, df.limit(0), 2).count() == 0
    assert V.index_pairs(empty, spark, 0.0).count() == 0


def test_blocks_travel_in_a_bounded_number_of_groups(spark, monkeypatch):
    """However many blocks a search looks into, a row meets the groups, whose number doesn't grow with the blocks."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    monkeypatch.setattr(V, "QUERY_ROWS", 16)
    monkeypatch.setattr(V, "GROUPS", 3)
    m = clustered(400, seed=2)
    df = table(spark, m, ODD)
    path = V.build(df, block_rows=8)
    blocks = spark.read.parquet(f"{path}/blocks")
    held, groups = V._grouped(blocks, V.directory(spark, path))
    assert groups == 3 and held.count() == 3 < blocks.count() / 10
    picked = []
    picks = V._picks
    monkeypatch.setattr(V, "_picks", lambda asked, shared, k, floors: picked.append(floors) or picks(asked, shared, k, floors))
    got = sorted(map(tuple, V.index_top_k(path, df, 3, itself=False).collect()), key=lambda r: (r[0], r[3]))
    score = V.half_up(m @ m.T)
    np.fill_diagonal(score, -np.inf)
    assert got == [(q, int(n), float(score[q, n]), i + 1) for q in range(len(m)) for i, n in enumerate(np.lexsort((np.arange(len(m)), -score[q]))[:3])]
    assert picked == [False]
    assert V.index_pairs(path, spark, 5.0).count() == int((np.triu(score, 1) > 5.0).sum())
