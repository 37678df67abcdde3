import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpusgraph.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def test_tokenizer_matches_library():
    texts = ["", "Don't STOP it's 3½ <|endoftext|> foó ΣΑΣ a\x1cb 9/10 \"q\"...!? 😀 they'll", "\n\n", "İstanbul’s “q” X'LL", "x" * 3000, "é ́x"]
    w = P.tokenizer(PATH)
    for t in texts:
        assert [*np.frombuffer(w.ids(t), "<u4"), 2] == reference_ids(t)


def test_pieces_cover_documents_and_sequences_are_gapless(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta,", "gamma.", "d3"]) for _ in range(rng.choice([0, 3, 50, 900, 5000])))) for i in range(60)]
    docs += [(None, "null key"), (7, None), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, length string")
    rows = P.pack_documents(df, PATH).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        if r.doc_id is not None and r.doc_id != 7:
            by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    for i, text in docs:
        if i in by_doc:
            ids, at = reference_ids(text), 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
                at += r.length
            assert at == len(ids)
    assert sum(r.length for r in rows) == sum(len(reference_ids(t)) for _, t in docs)
    assert P.pack_documents(df.limit(0), PATH).count() == 0


def test_columns_meet_demand_near_the_bound():
    rng = random.Random(4)
    demand = {rng.randrange(1, 257): rng.randrange(1, 400) for _ in range(120)}
    fractional = P.generate_columns(demand, 256)
    patterns = P.round_patterns(demand, fractional, 256)
    used = {}
    for pattern, n in patterns:
        assert sum(s * k for s, k in pattern.items()) <= 256
        for s, k in pattern.items():
            used[s] = used.get(s, 0) + k * n
    assert used == demand
    bound = sum(s * n for s, n in demand.items()) / 256
    assert sum(n for _, n in patterns) <= 1.02 * max(bound, sum(x for _, x in fractional)) + 2


def test_sequences_have_the_ids(spark):
    docs = [(1, "alpha beta"), (2, "gamma " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    packed = P.pack(P.cut(df, PATH, with_ids=True))
    seqs = P.sequences(packed).collect()
    assert all(len(s.ids) == 4 * 4096 for s in seqs)
    total = np.concatenate([np.frombuffer(bytes(s.ids), "<u4")[: s.n_tokens] for s in seqs])
    assert sorted(total.tolist()) == sorted(x for _, t in docs for x in reference_ids(t))


def test_classes_are_lengths_that_waste_little():
    rng = random.Random(6)
    for limit in (1, 2, 5, 40):
        histogram = {n: rng.randrange(1, 30) for n in rng.sample(range(1, 500), 40)}
        sizes = P.length_classes(histogram, limit)
        assert len(sizes) == min(limit, 40) and set(sizes) <= set(histogram) and max(sizes) == max(histogram)
    crowded = {n: 1 for n in range(1, 1000)} | {17: 10**6, 1: 10**6}
    assert {1, 17} <= set(P.length_classes(crowded, 20))
    assert P.length_classes({}) == []


def test_best_pattern_is_the_best_of_all():
    rng = random.Random(8)
    for _ in range(200):
        sizes = sorted(rng.sample(range(1, 30), rng.randrange(1, 6)))
        value = [rng.choice([0.0, rng.random()]) for _ in sizes]
        capacity = rng.randrange(30, 60)
        best = [0.0] * (capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes, value, strict=True) if s <= c)])
        worth, counts = P._best_pattern(sizes, np.array(value), capacity)
        assert abs(worth - best[capacity]) < 1e-9 and abs(counts @ np.array(value) - worth) < 1e-9
        assert counts @ np.array(sizes) <= capacity and counts.min() >= 0


def test_many_short_documents_are_packed_tight(spark):
    docs = [(i, None if i % 3 else "alpha " * 16) for i in range(20000)]
    packed = P.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    tokens = sum(r.length for r in packed)
    assert {r.length for r in packed} == {1, 17}
    assert len({r.sequence_id for r in packed}) <= tokens / 4096 * 1.02 + 1
