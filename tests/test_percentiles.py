import random

import numpy as np

from corpusgraph.operators import scorers as S
from corpusgraph.operators import stats as T
from corpusgraph.plans.percentiles import percentiles

AT = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def test_percentiles_by_group_match_numpy(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(5))) for _ in range(2500)] + [("wide", rng.random()) for _ in range(1700)]
    rows += [(None, 4.0), (None, 8.0), *[(None, float(i)) for i in range(50)], ("one", 7.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.q) for r in percentiles(df, "v", AT, ["k"]).collect()}
    assert set(got) == {"hot", "wide", None, "one"}
    for k, (n, q) in got.items():
        values = [v for key, v in rows if key == k and v is not None]
        assert n == len(values) and np.allclose(q, np.quantile(values, AT))


def test_percentiles_of_whole_and_empty_tables(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i) for i in range(100)], "n int, q int")
    row = percentiles(df, "q", AT).first()
    values = [i for i in range(100) if i % 7]
    assert row.n == len(values) and np.allclose(row.q, np.quantile(values, AT))
    row = percentiles(df.limit(0), "q", [0.5]).first()
    assert (row.n, row.q) == (0, [None])
    assert percentiles(df.limit(0), "q", [0.5], ["n"]).count() == 0


def test_describe_and_scale_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    got = {r.column: r for r in T.describe(df, ["a", "b"]).collect()}
    assert (got["a"]["count"], got["a"].q25, got["a"].q50, got["a"]["max"]) == (2, 1.5, 2.0, 3.0)
    assert (got["b"]["count"], got["b"].q50) == (0, None)
    assert S.robust_scale(df, "b").collect()[0].scaled is None
    assert S.robust_scale(df.limit(0), "a").count() == 0
    keyed = spark.createDataFrame([("x", 1.0, 5), ("x", 2.0, 5), (None, 3.0, 5)], "k string, weight double, n int")
    assert sorted(r.scaled for r in S.robust_scale(keyed, "weight", ["k"]).collect()) == [-1.0, 1.0]
