import random

import numpy as np
import xxhash

from corpusgraph.llm import simhash as S


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = [i for i, _ in fps if i is not None]
    of = {i: i for i in ids}
    root = lambda i: i if of[i] == i else root(of[i])
    rows = [(i, f) for i, f in fps if i is not None]
    for a, (i, f) in enumerate(rows):
        for j, g in rows[:a]:
            if bin((f ^ g) & (2**64 - 1)).count("1") <= 4:
                x, y = sorted((root(i), root(j)))
                of[y] = x
    return {i: root(i) for i in ids}


def test_fingerprint_matches_definition(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "One", "one two THREE", "a b c d", "a b c d e É", "ÀÉ x y z w", *(" ".join(rng.choices("abcdefg", k=n)) for n in (50, 5000))]
    assert [S.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]
    df = spark.createDataFrame([("One Two three four five",)], "t string")
    assert df.selectExpr("xxhash64('one two three four') as h").first().h % 2**64 == xxhash.xxh64_intdigest("one two three four", 42)


def planted(rng, n):
    out, base = [], [rng.getrandbits(64) for _ in range(n // 8)]
    for i in range(n):
        f = rng.choice(base) if rng.random() < 0.8 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 6])):
            f ^= 1 << b
        out.append((i, f))
    return out


def signed(f):
    return f - 2**64 if f >= 2**63 else f


def check(spark, rows):
    df = spark.createDataFrame([(i, signed(f)) for i, f in rows], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in df.join(S.components(df), "fp").select("doc_id", "component_id").where("doc_id is not null").collect()}
    assert got == brute_components(rows)


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    check(spark, planted(rng, 400) + [(1000, 0), (1001, 0), (1002, 15), (1003, 31 << 59), (None, 0)])


def test_hot_buckets_give_the_same_links(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(S, "HOT_WORK", 9)
    monkeypatch.setattr(S, "HEAVY", 1)
    fps = planted(rng, 120)
    sizes = S._table_sizes(spark.createDataFrame([(fp, i) for i, fp in {S.np.uint64(f).view(S.np.int64).item(): i for i, f in fps if i is not None}.items()], "fp long, rep long"))
    assert 0 < S._hot_buckets(sizes).count() <= sizes.count()
    check(spark, fps)


def test_probes_in_blocks_give_the_same_links(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(S, "HELD_ROWS", 50)
    check(spark, planted(rng, 300))


def test_rows_and_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "a"), (2, text.upper(), "b"), (9, "other words entirely here now", "c"), (9, "other words entirely here now", "c"), (None, text, "d"), (5, None, None), (6, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((str(r.doc_id), r.component_id) for r in S.near_duplicates(df).collect())
    assert got == [("2", 2), ("3", 2), ("5", 5), ("6", 5), ("9", 9), ("9", 9), ("None", None)]
    out = S.keep_one(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "5", "9", "None"]
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.keep_one(df.limit(0)).count() == 0
    # a third of the rows share key and text, and another third the text; odd column names stay
    odd = [(i, f"{i} " * 5, "a", i) for i in range(2000)] + [(5000, "same words in all of these rows", "b", 1)] * 1000 + [(6000 + i, "the same text with other keys", "c", 2) for i in range(1000)]
    df = spark.createDataFrame(odd, "doc_id long, text string, _gone string, _twin long")
    out = S.keep_one(df)
    got = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns and len(got) == len(set(got)) and {5000, 6000} == {i for i in got if i >= 5000}


def test_hot_link_points_are_linear():
    assert all(len([i for i in range(64) if not a <= i < a + b]) in (42, 43) for a, b in S.SEGMENTS)
    assert sum(b for _, b in S.SEGMENTS) == 64 and sum(r + 1 for r in S.RADII) > S.MAX_DISTANCE
    assert np.bitwise_count(np.uint64(2**64 - 1)) == 64
