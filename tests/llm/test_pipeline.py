import re

import corpus_pipeline as C
from corpusgraph.llm import decontamination, packing, simhash
from tests.llm.test_line_dedup import brute as deduped
from tests.llm.test_quality_rules import brute as measured
from tests.llm.test_simhash import brute_components, brute_fp
from tests.llm.test_decontamination import brute as contaminated


def test_pipeline_matches_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def good(t):
        n, chars, symbols, dup, rep = measured(t)
        lines = sum(1 for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r"))
        return n >= 20 and 100 * rep <= 30 * n and 10 * symbols <= n and 2 * dup <= lines and 2 * n <= chars <= 20 * n and 2 * t.count("!") <= n

    kept = sorted((i, t) for i, t in docs.items() if good(t))
    kept = list(zip([i for i, _ in kept], deduped(kept, 50), strict=True))
    comp = brute_components([(i, brute_fp(t)) for i, t in kept])
    kept = [(i, t) for i, t in kept if comp[i] == i]
    kept = [(i, t) for i, t in kept if not contaminated(t, items)[-1]]
    rows = C.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in kept}
    words = packing.tokenizer(C.tokenizer_path())
    want = {i: len(words.ids(t)) // 4 + 1 for i, t in kept}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(C.STAGES) in (4, 5) and all(re.fullmatch(r"[\w -]+", name) for name, _ in C.STAGES)
    empty = docs.limit(0)
    for name, stage in C.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
    assert callable(decontamination.report) and callable(simhash.keep_one)
