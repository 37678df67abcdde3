import hashlib
import random
import re

from corpusgraph.llm import decontamination as D


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc, items):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        t = words(text)
        spans = [tuple(t[i : i + 10]) for i in range(len(t) - 9)] if len(t) >= 10 else [tuple(t)] if t else []
        for s in set(spans):
            for i in range(len(w) - len(s) + 1):
                if tuple(w[i : i + len(s)]) == s:
                    hit |= set(range(i, i + len(s)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def fixture():
    rng = random.Random(3)
    vocab = ["a", "B", "é1", "thé", "x9", "ÀB", "zz", "0"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "\n", "--", "\x7f", " , "]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([25, 10, 9, 3, 1, 40, 12])] + [(7, None), (8, ""), (9, "..."), (None, text(15)), (5, text(11)), (2, "!?")]
    items[4] = (4, "rareword")
    docs = [(i, text(rng.choice([0, 5, 30, 200]))) for i in range(30)]
    for i in range(40):
        t = text(30)
        item = rng.choice(items)[1] or ""
        cut = rng.randrange(max(1, len(item)))
        docs.append((100 + i, t + item[cut:].upper() + " " + text(20) + item))
    return [*docs, (None, items[0][1]), (1, None), (2, ""), (3, "a " * 3000)], items


def test_hits_match_brute_force_for_any_block_size(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *brute(t, items)) for i, t in docs)
    assert sorted((str(r[0]), *r[1:]) for r in D.report(d, b).collect()) == want
    hits = D.find_hits(d, b, block_bytes=60)
    assert sorted((str(r.doc_id), r.n) for r in hits.select("doc_id", D.n_hit().alias("n")).collect()) == sorted((w[0], w[2]) for w in want)


def test_drop_contaminated_keeps_columns(spark):
    item = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, "clean text here", "x"), (2, "pre " + item, "y"), (3, None, None)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = D.drop_contaminated(d, b)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert D.report(d.limit(0), b).count() == 0
    assert [r.n_hit for r in D.report(d, b.limit(0)).collect()] == [0, 0, 0]
