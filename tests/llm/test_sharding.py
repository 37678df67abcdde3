import hashlib
import random
import zlib

from corpusgraph.llm import sharding
from corpusgraph.llm.sharding import assign_shards


def brute(docs, n_shards, percent=5):
    """Shard per row: running sizes in the order of (hash, key), groups of equal texts by their first row."""
    rows = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), -(2**63) if i is None else i, len((t or "").encode()) + 16, i) for i, t, *_ in docs)
    total, at, group, out, last = sum(r[2] for r in rows), 0, 0, [], None
    for h, _, size, i in rows:
        group = group if h == last else at
        cut = group if at - group <= total * percent // (100 * n_shards) else at
        out.append((str(i), size, min(n_shards - 1, cut * n_shards // total)))
        at, last = at + size, h
    return sorted(out)


def fixture():
    rng = random.Random(9)
    docs = [(i, " ".join(["wörd"] * rng.randrange(0, 60)) + str(i), "s") for i in range(3000)]
    docs += [(5000 + i, "hot text that repeats " * 5, "s") for i in range(1500)] + [(7000 + i, f"pair {i // 2} " * 9, "s") for i in range(60)]
    return docs + [(None, "null key", None), (3, None, None), (4, "", "s"), (4, "", "s")] + [(9, "same key and text " * 4, "s")] * 700


def test_law_bytes(spark, monkeypatch):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string")
    total = sum(len((t or "").encode()) + 16 for _, t, _ in docs)
    for per_shard in (8, 60):  # few ranges, and so many that groups go on through several
        monkeypatch.setattr(sharding, "RANGES_PER_SHARD", per_shard)
        rows = assign_shards(df, 8).collect()
        assert sorted((str(r.doc_id), r.size, r.shard) for r in rows) == brute(docs, 8)
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r)
        assert sorted(by) == list(range(8))
        for part in by.values():
            assert sorted(r.slot for r in part) == list(range(len(part)))
            assert abs(sum(r.size for r in part) - total / 8) <= 0.06 * total / 8
        want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in docs)
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
        pairs = {}
        for r in rows:
            if r.doc_id is not None and 7000 <= r.doc_id < 7060:
                pairs.setdefault(r.text_crc32, set()).add(r.shard)
        assert all(len(s) == 1 for s in pairs.values())
        assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert assign_shards(df.limit(0), 8).count() == 0


def test_long_texts_and_one_row(spark):
    docs = [(1, "x" * 3_000_000, "s"), *((i, f"{i}", "s") for i in range(2, 40)), (50, "y" * 2_000_000, "s"), (51, None, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _h string")
    assert sorted((str(r.doc_id), r.size, r.shard) for r in assign_shards(df, 4).collect()) == brute(docs, 4)
    assert [r.shard for r in assign_shards(df.where("doc_id = 51"), 4).collect()] == [0]


def test_splitters_subdivide_repeated_rows(spark):
    df = spark.createDataFrame([(9, "same " * 50, "s")] * 4000 + [(i, f"t{i}", "s") for i in range(200)], "doc_id long, text string, s string")
    rows = assign_shards(df, 8).collect()
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 0.12 * sum(sizes) / 8
