import random
import re
from collections import Counter

import pytest

from corpusgraph.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, c int, rank string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count=30, max_n=4, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    out = {}
    for (lang, w), a in found.items():
        if any(la == lang and len(x) > len(w) and 100 * b >= 80 * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (la, x), b in found.items()):
            continue
        score, _, le, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), le, r))
    return sorted((lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top]))


def ranked(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(rng, words, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(words))
        out.append(rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "!\r", "  "]))
    return "".join(out)


@pytest.mark.parametrize("min_count,max_n,block", [(5, 4, 2 << 20), (3, 5, 200), (30, 2, 2 << 20), (1, 4, 64)])
def test_equals_brute_force(spark, monkeypatch, min_count, max_n, block):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    rng = random.Random(min_count)
    words = ["New", "york", "CITY", "of", "the", "É", "é", "a-b", "x'", "\x00", "日本", "|", "(", "zz"]
    rows = [(prose(rng, words[: rng.randint(2, len(words))], rng.randint(0, 60 if min_count > 1 else 15)), rng.choice(["en", "de", None, ""])) for _ in range(60 if min_count > 1 else 15)]
    df = spark.createDataFrame([(i, t, la, "clash", 1, "x") for i, (t, la) in enumerate(rows)], SCHEMA).repartition(5)
    assert ranked(C.collocations(df, min_count, max_n)) == brute(rows, min_count, max_n)
    assert ranked(C.collocations(df, min_count, max_n, top=3)) == brute(rows, min_count, max_n, 3)


def test_a_full_map_costs_rows_only(spark, monkeypatch):
    """With every bit of the map set, n-grams with rare parts are emitted and counted, and the result is the same."""
    rng = random.Random(9)
    rows = [(prose(rng, [f"w{i}" for i in range(12)], 80), "en") for _ in range(20)]
    df = spark.createDataFrame([(0, t, la, None, None, None) for t, la in rows], SCHEMA)
    want = brute(rows, 6)
    assert ranked(C.collocations(df, 6)) == want
    full = C.frequency_map(df.limit(0).select("lang", "phrase")) - 1
    monkeypatch.setattr(C, "frequency_map", lambda frequent: full)
    assert ranked(C.collocations(df, 6)) == want


def test_overlaps_ties_and_covered_phrases(spark):
    rows = [("go go go go go", "en")] * 10 + [("p q", "en")] * 8 + [("p q r", "en")] * 32 + [("A b", "en")] * 40 + [("a c", None), (None, "en"), ("", None), ("x " * 5000, "fr")]
    df = spark.createDataFrame([(None, t, la, None, None, None) for t, la in rows], SCHEMA)
    assert ranked(C.collocations(df)) == brute(rows)


def test_empty_table_and_bad_parameters(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        C.collocations(spark.createDataFrame([], SCHEMA), max_n=1)
