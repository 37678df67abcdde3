import random
import zlib

import numpy as np

from corpusgraph.llm import toxicity as T


def corpus(n=900):
    rng = random.Random(6)
    plain = [f"wort{i}" for i in range(300)]
    bad = [f"grmpf{x}" for x in "abcdefghij"] + ["idiot", "scum"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_rows(spark):
    docs, labels = corpus()
    truth = {i: t for i, _, t in labels}
    d, lab = frames(spark, [*docs, (5000, None, "y"), (5001, "", None), (None, "idiot scum grmpfa", "z"), (1, docs[1][1], "x")], [*labels, (None, 1, 1), (7, 1, None)])
    rows = T.score_documents(d, lab).collect()
    assert len(rows) == len(docs) + 4
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(out) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.98
    assert all(r.predicted == 0 for r in rows if r.doc_id in (5000, 5001))
    assert T.score_documents(d.limit(0), lab).count() == T.score_documents(d.limit(0), lab.limit(0)).count() == 0


def fitted(docs, labels):
    return T.fit(lambda s: T.look(docs, s, ["doc_id"], "text"), docs, labels)[0]


def score(s, text):
    return 1 / (1 + np.exp(-(np.array(s.features(text)[0]) @ s.weights + s.bias)))


def test_a_rare_language_is_learned_at_any_size(spark):
    """Toxic words of 1 % of the toxic rows are learned; words that one group of near copies shares are not."""
    docs, labels = corpus(6000)
    rng = random.Random(7)
    rare = rng.sample([i for i, _, t in labels if t], 15)
    other = [f"szo{i}" for i in range(40)]
    for i in rare:
        docs[i] = (i, " ".join([*rng.sample(other, 30), "zumbrak", "kolvent"]), "x")
    for i in [i for i, _, t in labels if not t][:60]:
        docs[i] = (i, " ".join(rng.sample(other, 30)), "x")
    copied = [f"kopie{i}" for i in range(200)]
    for k, i in enumerate([i for i, _, t in labels if t and i not in rare][:60]):
        docs[i] = (i, " ".join([*copied, "idiot", "grmpfa", f"nr{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}"]), "x")
    s = fitted(*frames(spark, docs, labels))
    assert {"=zumbrak", "=kolvent"} <= s.entries.keys() and not any(e.startswith(("=szo", "=kopie")) for e in s.entries)
    assert all(score(s, docs[i][1]) > 0.5 for i in rare) and score(s, " ".join(other)) < 0.5


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (fitted(*frames(spark, docs, x)) for x in (labels, flipped))
    assert a.entries == b.entries and np.allclose(a.weights, b.weights)


def test_odd_labels_are_none(spark):
    docs, labels = corpus(300)
    odd = [(i, q, t if i % 3 else (-1 if t else 7)) for i, q, t in labels]
    none = [(i, q, t if i % 3 else None) for i, q, t in labels]
    a, b = (fitted(*frames(spark, docs, x)) for x in (odd, none))
    assert a.entries == b.entries and a.entries and np.allclose(a.weights, b.weights)


def test_without_labels_the_lexicons_and_patterns_score(spark):
    docs, labels = corpus(400)
    d, lab = frames(spark, docs, labels)
    s = fitted(d, lab.limit(0))
    assert not s.entries and score(s, "you idiot") > 0.5 > score(s, "you") and score(s, None) < 0.5


def test_patterns_and_long_texts():
    def vote(text):
        return [p for p, v in zip(T.PATTERNS, T.pattern_votes(text, T.words_of(text)), strict=True) if v]

    assert vote("you are such an idiot") == ["targeted"] and vote("what an Idiot, you") == ["targeted"] and vote("the idiot of it") == []
    assert vote("SHUT UP NOW ALL") == ["shouting"] or vote("SHUT YOUR LOUD MOUTH") == ["shouting"]
    assert vote("a st*pid 1diot") == ["masked"] and vote("cash is $5, n0 way") == []
    assert vote("I will really hurt them") == ["threatening"] and vote("kill time") == []
    s = T.Scorer({"grm": 4})
    x, votes = s.features("clean words " * 200_000 + "grmpf idiot idiot grmpf")
    assert votes == 1 | 1 << 4 | 1 << (T.N_VOTERS - 3) and len(x) == T.N_FEATURES
    assert s.features(None) == s.features("") == ([0.0] * T.N_FEATURES, 1 << (T.N_VOTERS - 1))


def test_families_are_the_strongest_beginnings():
    got = T.families(["=aaab", "aaa", "=aaac", "=bbbx", "=bbby", *(f"={c * 3}" for c in "cdefgh"), "=idiot"])
    assert {got["=aaab"], got["aaa"]} == {4} and got["=bbbx"] == 5 and got["=hhh"] == 4 + T.N_FAMILIES and "=idiot" not in got


def test_label_model_finds_good_and_bad_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.55])
    up = (rng.random((4000, 5)) < accuracy) == y[:, None]
    up = np.column_stack([up, up[:, 3]])  # a copy of a voter adds nothing
    rates = np.stack([up[~y][:150].mean(axis=0), up[y][:80].mean(axis=0)])
    post, found, corr = T.label_model(up, np.ones(4000), rates, 0.3)
    assert np.mean((post > 0.5) == y) > 0.93
    assert np.abs((1 - found[0] + found[1])[:5] / 2 - accuracy).max() < 0.08
    assert corr[3, 5] > 0.9
    # patterns with counts are the same as their rows
    some, counts = np.unique(up, axis=0, return_counts=True)
    assert np.allclose(T.label_model(some, counts.astype(float), rates, 0.3)[1], found, atol=1e-4)
