import random

import pytest
from tokenizers import Tokenizer

from corpusgraph.llm import token_counts as T
from corpusgraph.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


@pytest.fixture(scope="module")
def want(path):
    t = Tokenizer.from_file(path)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def odd_text(rng, n):
    """Words, marks, capitals that change their length, special strings, digits and long runs, in any order."""
    bits = ["a", "word", " ", "  ", "\n", "don't", "we'll", "é", "é", "q̣́", "́", "İ", "ß", "ǅ", "한", "하", "漢字", "。", "😀", "12345", "...", "<|endoftext|>", "<|startoftext|>", "<|end", "text|>", "x" * 30, " ", "\xa0", "'s", "ﬁ"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_chunks_of_any_size_give_the_whole_text_s_count(spark, path, want):
    rng = random.Random(5)
    texts = [odd_text(rng, n) for n in (200, 400, 900) for _ in range(25)]
    texts += ["a" * 3000, "a" * 700 + " b" * 300 + "c" * 2000, "́" * 500, "1" * 900, "<|endoftext|>" * 90, " " * 3000, "no space," * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, overlap in ((40, 40), (64, 20), (300, 100)):
        got = {r.doc_id: r.n_tokens for r in T.count_tokens(df, path, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: want(t) for i, t in enumerate(texts)}


def test_neighbours_splice_at_stable_boundaries_only(path):
    # the second chunk starts within a letter that composes, within a word, and within a special string
    text = "one café two <|endoftext|> three four five six seven eight nine ten eleven twelve"
    for start in range(1, 40):
        left = T.summary(path, text[: start + 40], 0, 2, 40)
        right = T.summary(path, text[start:], 1, 2, 40)
        common = sorted(set(left[3]) & set(right[1]))
        assert common
        for at in common:
            n = left[4][left[3].index(at)] + right[0] - right[2][right[1].index(at)]
            assert n == T.word_starts(path, text)[2]


def test_a_word_longer_than_the_overlap_is_taken_again(spark, path, want):
    text = "start " + "ab" * 400 + " end"
    df = spark.createDataFrame([(0, text)], "row long, text string")
    once = T.spliced(T._encoded(T._cut(df, 100, 50), path, 50)).first()
    assert once.n_tokens is None
    assert T.long_counts(df, path, 100, 50).first().n_tokens == want(text)


def test_odd_rows(spark, path, want):
    long = "Größe, 12 words <|endoftext|> " * 3000
    rows = [(1, None, "a", 1), (2, "", "a", 1), (None, "x y", "a", 1), (1, "x y", None, None), (1, "x y", None, None), (None, long, None, None), (7, long, None, None), (8, long + long, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_tokens int")
    got = T.count_tokens(df, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(i, len((t or "").encode()), want(t), want(t) > 2048) for i, t, *_ in rows], key=key)
    assert T.count_tokens(df.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        T.count_tokens(df, path, chunk=8, overlap=8)


def test_given_documents(spark, sf, path, want):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(docs, path, chunk=500, overlap=100).collect()}
    assert got == {r.doc_id: want(r.text) for r in docs.collect()}


def test_texts_as_sums_of_their_parts(path, want, monkeypatch):
    assert T.adds_up(path) and not T.adds_up(path.replace("word_bpe_49k", "byte_bpe_50k"))
    monkeypatch.setattr(T, "KNOWN_PARTS", 40)
    rng = random.Random(6)
    texts = [odd_text(rng, n) for n in range(0, 120)] * 2
    assert T.lengths(path, texts) == [want(t) for t in texts]
    byte = path.replace("word_bpe_49k", "byte_bpe_50k")
    t = Tokenizer.from_file(byte)
    assert T.lengths(byte, texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
