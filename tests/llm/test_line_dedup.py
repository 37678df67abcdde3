import random
import re

from pyspark.sql import functions as F

from corpusgraph.llm import line_dedup as L


def brute(docs, min_words):
    """Lines in any run of enough words with an earlier copy, for distinct (id, text) in order."""
    seqs = [(i, t.split("\n")) for i, t in docs]
    n_words = lambda lines: sum(len(re.findall(r"[^\x20\x09-\x0d]+", x)) for x in lines)
    seen, gone = {}, []
    for at, (_, lines) in enumerate(seqs):
        drop = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if n_words(run) >= min_words and run in seen:
                    doc, first = seen[run]
                    drop |= set(range(max(i, first + len(run)) if doc == at else i, j))
            # runs that start at or before line i are earlier than those of the next line
            for j in range(i + 1, len(lines) + 1):
                seen.setdefault(tuple(lines[i:j]), (at, i))
        gone.append("\n".join(x for k, x in enumerate(lines) if k not in drop))
    return gone


def test_matches_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7))) for _ in range(12)] + ["", " "]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(2, 9))] for _ in range(5)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice([rng.choice(runs), [f"own {i} {rng.random()}"], [rng.choice(pool)]])
        docs.append((i, "\n".join(lines)))
    docs += [(100, "x y\n" * 30), (101, "")]
    df = spark.createDataFrame([(*d, "w") for d in docs], "doc_id long, text string, start string")
    for min_words in (1, 6, 10):
        got = {r.doc_id: r.text for r in L.dedup_lines(df, min_words=min_words).collect()}
        want = brute(docs, min_words)
        assert [got[i] for i, _ in docs] == want


def test_first_copies_that_overlap_the_next_stay_whole(spark):
    equal, turns = "one two three four five", ["a b c d e", "f g h i j"]
    docs = [(1, "\n".join([equal] * 100)), (2, "\n".join(turns * 20)), (3, "\n".join(turns * 7)), (4, "\n".join([equal] * 9 + ["end"])), (5, "\n".join(["x", *[equal] * 12]))]
    got = {r.doc_id: r.text.split("\n") for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == [equal] * 10 and got[2] == turns * 5 and got[4] == [equal] * 9 + ["end"] and got[5] == ["x"]
    assert [got[i] for i, _ in docs] == [x.split("\n") for x in brute(docs, 50)]


def test_nulls_repeats_and_columns(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "head\n" + passage, "p"), (2, passage + "\ntail", "q"), (2, passage + "\ntail", "q"), (3, None, "r"), (None, passage, None), (4, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_deleted"]
    got = sorted((str(r.doc_id), r.text, r._n_deleted) for r in out.collect() if r.text is not None)
    assert got == [("1", "head", 1), ("2", "tail", 1), ("2", "tail", 1), ("4", "", 0), ("None", passage, 0)]
    assert L.dedup_lines(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit("kept") for c in ("_n_lines", "_gone", "_gone_key", "_gone_text", "d", "th")})
    out = L.dedup_lines(clash)
    assert out.columns == [*clash.columns, "__n_lines", "_n_deleted"]
    assert {r[0] for r in out.select("_n_lines").union(out.select("_gone")).collect()} == {"kept"}
    assert L.dedup_lines(clash, counts=None).columns == clash.columns


def test_heavy_groups_long_texts_and_blank_lines(spark):
    """A line in a third of all rows, a run in many texts, and a copied stretch of many blank lines."""
    common = [" ".join(f"c{i}x{j}" for j in range(12)) for i in range(6)]
    docs = [(i, "\n".join([common[0], f"own line {i}", *(common if i % 3 == 0 else common[:3])])) for i in range(1500)]
    blank = "first " * 30 + "\n" * 3000 + "last " * 30
    docs += [(5000, blank), (5001, "head\n" + blank + "\ntail"), (5002, "long text\n" + "word " * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert got[0] == docs[0][1] and got[3] == f"{common[0]}\nown line 3"
    assert got[1] == docs[1][1] and got[5000] == blank and got[5002] == docs[-1][1]
    assert got[5001] == "head\ntail"


def test_ranks_are_places_in_the_sorted_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(5), rng.randrange(4)) for i in range(200)] + [(999, 9, 9)]
    got = {r.pos: r["rank"] for r in L.rank_suffixes(spark.createDataFrame(rows, "pos long, left long, right long"), ["left", "right"]).collect()}
    pairs = sorted((x, y) for _, x, y in rows if sum((a, b) == (x, y) for _, a, b in rows) > 1)
    assert got == {p: pairs.index((x, y)) for p, x, y in rows if (x, y) in pairs}
