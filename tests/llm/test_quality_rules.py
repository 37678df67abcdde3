import random
import re

from corpusgraph.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, n_words string, fail_bits string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(1)
    out = [None, "", " \t\n", "a", "é😀 x\x0by\x0cz", "same line\nsame line\n\n same line", "#$% | <a> *&"]
    for n in (7, 8, 9, 30, 300):
        out.append(" ".join(rng.choice("ab") for _ in range(n)))
        out.append("\n".join(rng.choice(["a b c", "d", "", "e f g h i j k l m"]) for _ in range(n)))
    return out + [" ".join(str(i) for i in range(5000)), "x" * 50000]


def test_measurements_match_brute_force(spark):
    rows = [(i if i != 3 else None, t, "clash", "clash") for i, t in enumerate(texts())]
    got = Q.ledger(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")).collect()
    want = sorted((str(r[0]), *brute(r[1])) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_policy_keeps_columns_and_clean_rows(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "a", "b"), (2, "short", "a", "b"), (3, "spam ### " * 30, "a", "b"), (4, None, None, None), (1, good, "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = Q.apply_policy(df)
    assert out.columns == df.columns
    assert [r.doc_id for r in out.collect()] == [1, 1]
    assert Q.apply_policy(df.limit(0)).count() == 0


def test_ablations_count_bits(spark):
    led = spark.createDataFrame([(0b1,), (0b11,), (0b100,), (0,)], "fail_bits long")
    got = {(r.policy, r.rule): (r.n_docs, r.n_rejected, r.n_failing, r.n_only) for r in Q.ablations(led).collect()}
    assert got["base", "few_words"] == (4, 2, 2, 1)
    assert got["base", "repeated_words"] == (4, 2, 1, 0)
    assert got["v1", "symbols"] == (4, 3, 1, 1)
