from fractions import Fraction

import numpy as np

from corpusgraph.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def brute(vectors):
    """All columns but the sign of a component, from exact sums and a covariance of centred integers."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    d = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(row, s)] for row in x])
    cov = np.array([[float(sum(Fraction(int(p) * int(q)) for p, q in zip(n * x[:, i] - s[i], n * x[:, j] - s[j])) / n**3) for j in range(x.shape[1])] for i in range(x.shape[1])])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    return n, deviation, d, e, v


def check(spark, rows, k=32, sizes=(1, 5)):
    vectors = [[np.float32(c) for c in v] for _, v in rows]
    n, deviation, d, e, v = brute(vectors)
    for parts in sizes:
        df = spark.createDataFrame([(i, x, "clash", None) for i, x in rows], SCHEMA).repartition(parts)
        out = W.whiten(df, k=k).toPandas()
        assert len(out) == len(rows) * min(k, len(e)) and set(out["n"]) == {n}
        assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] <= 1e-9
        for c, part in out.groupby("component"):
            part = part.set_index("vec_id").loc[[i for i, _ in rows]]
            want = d @ v[:, c - 1] / np.sqrt(e[c - 1])
            got = part["whitened"].to_numpy()
            assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
            assert abs(part["explained"].iloc[0] / (e[c - 1] / e.sum()) - 1) < 1e-9
            assert part["deviation"].tolist() == deviation


def test_matches_an_exact_covariance(spark):
    rng = np.random.default_rng(3)
    for n, dims in ((40, 3), (200, 7), (60, 1)):
        a = rng.normal(size=(n, dims)) * (2.0 ** -np.arange(dims)) @ rng.normal(size=(dims, dims))
        check(spark, [(i, a[i].tolist()) for i in range(n)])


def test_more_components_than_asked_for(spark):
    a = np.random.default_rng(4).normal(size=(120, 6))
    check(spark, [(i, a[i].tolist()) for i in range(len(a))], k=2)


def test_jacobi_keeps_small_deviations():
    rng = np.random.default_rng(5)
    q1, q2 = np.linalg.qr(rng.normal(size=(30, 9)))[0], np.linalg.qr(rng.normal(size=(9, 9)))[0]
    sigma = 10.0 ** -np.arange(9)
    r = np.linalg.qr(q1 * sigma @ q2.T, mode="r")
    got, v = W.jacobi_svd(r)
    assert np.allclose(got, sigma, rtol=1e-7) and np.allclose(v.T @ v, np.eye(9), atol=1e-13)
    assert np.allclose(np.abs((v * q2).sum(0)), 1, atol=1e-7)
    assert W.jacobi_svd(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_a_hot_vector_and_repeats(spark):
    a = np.random.default_rng(6).normal(size=(80, 4)).tolist()
    check(spark, [(i, x) for i, x in enumerate(a + [a[0]] * 160)], sizes=(3,))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    sound = [(1, [0.5, -0.25]), (None, [1.5, 2.0]), (3, [-1.0, 0.0]), (3, [-1.0, 0.0])]
    odd = [(4, None), (5, [0.1, None]), (6, [nan, 0.0]), (7, [0.0, -inf]), (8, []), (9, [1.0, 2.0, 3.0])]
    out = W.whiten(spark.createDataFrame([(i, v, "x", 1) for i, v in sound + odd], SCHEMA)).toPandas()
    assert len(out) == 2 * len(sound) and set(out["n"]) == {4} and out["identity_error"].max() < 1e-12
    assert W.whiten(spark.createDataFrame([(i, v, "x", 1) for i, v in odd[:4]], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    # a dimension without variance, then no variance at all
    flat = W.whiten(spark.createDataFrame([(i, [float(i), 2.0], "x", 1) for i in range(5)], SCHEMA)).toPandas()
    assert flat[flat.component == 2]["whitened"].isna().all() and flat[flat.component == 1]["whitened"].notna().all()
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x", 1)], SCHEMA)).toPandas()
    assert one["whitened"].isna().all() and one["deviation"].tolist() == [0, 0] and one["explained"].tolist() == [0.0, 0.0]


def test_wide_entries_add_without_wrapping(spark):
    big = [(1, [3.0e7, 0.0]), (2, [-3.0e7, 1.0])]
    out = W.whiten(spark.createDataFrame([(i, v, "x", 1) for i, v in big], SCHEMA)).toPandas()
    x = [int(64 * 3.0e7), -int(64 * 3.0e7)]
    want = sum((2 * x[0] - sum(x)) ** 2 for _ in [0]) + (0 - 64) ** 2
    assert (want >= 1 << 63 and out["deviation"].isna().all()) or set(out["deviation"]) == {want}
