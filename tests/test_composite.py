import datetime as dt
import random

import pytest

from corpusgraph.operators import composite, scorers, search

SCHEMA = (
    "id long, name string, name_emb array<double>, embedding array<float>, desc_emb array<double>, type string, authors array<string>, topics array<string>, "
    "brands array<string>, divisions array<string>, mpc_round long, forecast_round string, date date"
)
TYPES = ["Speech", "Data Response", "Essential Reading", "Monetary Policy Report", "Other", "Recommended reading"]
WORDS = ["Smith", "smith", "Smyth", "Jones", "Jonas", " ", "", "Ümit", "Brown", "Browne", "nan", "NaN"]


def rows(rng, n, odd=False):
    vector = lambda d: [rng.gauss(0, 0.4) for _ in range(d)]
    some = lambda: [rng.choice(WORDS) for _ in range(rng.randrange(0, 4))]
    out = []
    for i in range(n):
        r = [i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 4))), vector(3), vector(4), vector(2), rng.choice(TYPES), some(), some(), some(), some(),
             rng.choice([1, 2, None]), rng.choice(["a", "b", None]), dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(0, 500))]
        if odd and rng.random() < 0.3:
            j = rng.randrange(1, len(r))
            r[j] = [1.0] if j in (2, 3, 4) and rng.random() < 0.5 else [None] if j in range(6, 10) and rng.random() < 0.5 else None
        out.append(tuple(r))
    return out


class Every:
    """The same scorer without bounds: all pairs are scored."""

    def __init__(self, scorer):
        self.scorer, self.columns = scorer, scorer.columns

    def __call__(self, a, b):
        return self.scorer(a, b)


@pytest.mark.parametrize("odd", [False, True])
def test_same_as_scoring_every_pair(spark, odd):
    df = spark.createDataFrame(rows(random.Random(7 + odd), 50, odd), SCHEMA).repartition(3)
    asked = df.where("id % 4 = 0")
    for scorer, k in ((scorers.MeanScorer(), 3), (scorers.WeightedScorer(), 60)):
        got = sorted(map(tuple, search.scored_top_k(df, asked, scorer, "id", k).collect()))
        want = sorted(map(tuple, search.scored_top_k(df, asked, Every(scorer), "id", k).collect()))
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
        assert all(a[2] is b[2] is None or abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


def test_few_pairs_are_scored(spark):
    df = spark.createDataFrame(rows(random.Random(9), 600), SCHEMA)
    side = lambda p: df.select(*[df[c].alias(p + c) for c in df.columns])
    asked = side("a_").where("a_id < 20")
    assert composite.likely_pairs(side("b_"), asked, "id", scorers.MeanScorer.weights, 5).count() < 600 * 20 / 10


def test_no_rows(spark):
    df = spark.createDataFrame(rows(random.Random(1), 5), SCHEMA)
    assert search.scored_top_k(df.limit(0), df, scorers.MeanScorer(), "id").count() == 0
    assert search.scored_top_k(df, df.limit(0), scorers.MeanScorer(), "id").count() == 0
