import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from locusforge.llm import entry, shared, tokencount
from tests.llm import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " a  b\n", "é😀　x", "<s> </s> <unk>", "the cat", "the cat", "w" * 60_000, "\x00\x01"]


def test_query_equals_the_library(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = entry.op10_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_both_libraries(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith("model"):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    else:
        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(brute.docs(spark, TEXTS), path).collect()}
    assert got == {i: count(t or "") for i, t in enumerate(TEXTS)}


def test_cache_encodes_only_misses(spark, monkeypatch):
    cache, d = shared.scratch(spark, "cache"), brute.docs(spark, TEXTS)
    first = sorted(map(tuple, tokencount.count_tokens(d, MODEL, cache).collect()))
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in TEXTS})
    poisoned = shared.scratch(spark, "poisoned")  # counts come from the cache, not from encoding again
    stored.selectExpr("content", "n_tokens + 1000 as n_tokens", "tokenizer").write.parquet(poisoned)
    again = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(d.union(brute.docs(spark, ["new"], 50)), MODEL, poisoned).collect()}
    assert again[50] < 10 and all(again[i] == n + 1000 for i, _, n, _ in first)
    assert spark.read.parquet(poisoned).count() == stored.count() + 1
    monkeypatch.setattr(shared, "SIEVE_BITS", 4)
    monkeypatch.setattr(shared, "HOT_KEYS", 2)
    assert sorted(map(tuple, tokencount.count_tokens(d, MODEL).collect())) == first


def test_another_tokenizer_is_another_key(spark):
    cache, d = shared.scratch(spark, "two"), brute.docs(spark, ["the cat sat"])
    a = tokencount.count_tokens(d, MODEL, cache).first().n_tokens
    b = tokencount.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json"), cache).first().n_tokens
    assert (a, b) == (tokencount.count_tokens(d, MODEL, cache).first().n_tokens, b) and spark.read.parquet(cache).count() == 2


def test_edges(spark):
    d = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (4, "c", 3)], "doc_id long, text string, n_tokens int")
    assert tokencount.count_tokens(d, MODEL).count() == 3
    assert tokencount.count_tokens(d.limit(0), MODEL).count() == 0
    assert tokencount.count_tokens(d, MODEL, limit=1).where("over_limit").count() == 2


def test_very_long_texts_and_clashing_names(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    long = "some words to count " * 60_000
    d = brute.docs(spark, [long, "a"]).selectExpr("*", "'a' as path", "1 as content", "2 as tokenizer", "3 as n_bytes")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(d, MODEL).collect()}
    assert got == {0: (len(long), len(library.encode(long))), 1: (1, len(library.encode("a")))}
