import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import metrics
from corpusgraph.operators import fuzzy, scorers


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def words(rng, n, letters="abcde", longest=14):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, longest))) for _ in range(n)]


def test_lcs_of_all_lengths_both_ways(spark):
    rng = random.Random(2)
    pairs = [(a, b) for n in (3, 9, 61, 62, 63, 64, 65, 130, 200) for a, b in zip(words(rng, 12, "abé😀", n + 1), words(rng, 12, "abé😀", n + 1))]
    pairs += [("", ""), ("", "abc"), ("x" * 64, "x" * 64), ("x" * 124, "x" * 124), ("ab" * 60, "ba" * 60)]
    want = [lcs(a, b) for a, b in pairs]
    assert fuzzy.lcs_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.n for r in df.select("i", metrics.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()}
    assert [got[i] for i in range(len(pairs))] == want


@pytest.mark.parametrize("threshold", [1.0, 0.8, 0.7, 0.5])
def test_close_pairs_lose_none(spark, threshold):
    rng = random.Random(int(threshold * 10))
    a, b = words(rng, 120) + ["", "same", None], words(rng, 120) + ["", "same", "same", None]
    x, y = (spark.createDataFrame([(s,) for s in v], "s string") for v in (a, b))
    got = {(r.x, r.y): r.ratio for r in fuzzy.close_pairs(x, y, "s", "s", threshold).collect()}
    want = {(p, q): ratio(p, q) for p in {*a} - {None} for q in {*b} - {None} if ratio(p, q) >= threshold - 1e-12}
    assert got == want
    assert fuzzy.close_pairs(x.limit(0), y, "s", "s").count() == 0


def test_fewer_pairs_meet_than_there_are(spark):
    rng = random.Random(3)
    names = [" ".join(rng.choice(["small", "large", "bright", "dull", "red", "green", "rusty"]) + str(rng.randrange(100)) for _ in range(3)) for _ in range(300)]
    x = fuzzy.strings_of(spark.createDataFrame([(s,) for s in names], "s string"), "s")
    need = fuzzy.ratio_need(0.9)
    found = fuzzy.candidates(x, x, need)
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert found.count() < len({*names}) ** 2 / 4
    assert {(r.x, r.y) for r in fuzzy.verified(found, need).collect()} == {(p, q) for p in {*names} for q in {*names} if ratio(p, q) >= 0.9 - 1e-12}


def test_fuzzy_lists(spark):
    rng = random.Random(4)
    items = ["Smith", "smith", "Smyth", "Jones", "Jonas", "Brown", " ", "", "Browne"]
    lists = [[rng.choice(items) for _ in range(rng.randrange(0, 5))] for _ in range(30)]
    df = spark.createDataFrame([*enumerate(lists), (None, ["Smith"]), (99, None)], "id long, names array<string>")
    got = {(r.a, r.b): r.jaccard for r in fuzzy.fuzzy_list_pairs(df, df, "id", "names").collect()}
    both = df.where("id < 99").select(F.col("id").alias("a"), F.col("names").alias("x")).crossJoin(df.where("id < 99").select(F.col("id").alias("b"), F.col("names").alias("y")))
    want = both.select("a", "b", metrics.list_jaccard(F.col("x"), F.col("y"), metrics.close_match()).alias("j")).where("j > 0")
    assert got == {(r.a, r.b): r.j for r in want.collect()}


def test_best_names_equal_the_full_product(spark):
    rng = random.Random(5)
    names = words(rng, 60, "abAB1 ", 12) + ["Annual Report 2020.pdf", "", None, "zzz"]
    others = words(rng, 80, "abAB1 -", 16) + ["annual-report 2020", "Annual Report", None, ""]
    x, y = spark.createDataFrame([(s,) for s in names], "n string"), spark.createDataFrame([(s,) for s in others], "m string")
    squeeze = lambda s: "".join(c for c in s if c.isascii() and c.isalnum())

    def score(a, b):
        a, b = squeeze(a), squeeze(b)
        p, q = (a, b) if len(a) <= len(b) else (b, a)
        part = max((ratio(p, q[i : i + len(p)]) for i in range(len(q) - len(p) + 1)), default=0) if p else float(not q)
        return round(0.4 * ratio(a, b) + 0.3 * part + 0.3 * ratio(a.lower(), b.lower()), 6)

    for low in (0.0, 0.6):
        got = {r.name: (r.match, r.score) for r in scorers.best_match(x, y, "n", "m", low).collect()}
        assert got.keys() == {*names} and got[None] == ("", -1.0)
        for n in {*names} - {None}:
            ranked = sorted((-score(n, m), len(m), m) for m in {*others} - {None} if score(n, m) > low)
            want = (ranked[0][2], -ranked[0][0]) if ranked else ("", -1.0)
            assert got[n][0] == want[0] and np.isclose(got[n][1], want[1]), n
