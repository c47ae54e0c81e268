import io
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from locusforge.llm import entry, shared, tokenbin
from tests.llm import brute

JSON = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.just(0), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_pack_and_unpack(values):
    ids = np.array(values, np.uint64)
    words, away, escaped = tokenbin.pack(ids)
    assert (tokenbin.unpack(words, len(ids), away, escaped) == ids).all()


def test_every_selector_and_size():
    for count, bits in tokenbin.SELECTORS:
        top = (1 << bits) - 1
        ids = np.full(3 * count + 1, top, np.uint64)
        words, away, escaped = tokenbin.pack(ids)
        assert (tokenbin.unpack(words, len(ids), away, escaped) == ids).all()
        assert len(words) <= 4 + (bits == 0)
    ids = np.random.default_rng(1).integers(0, 50_257, 100_000).astype(np.uint64)
    assert len(tokenbin.pack(ids)[0]) * 8 < 3 * len(ids)


def write(docs):
    out = io.BytesIO()
    w = tokenbin.Writer(out)
    for d in docs:
        w.add(np.array(d, np.uint32))
    w.close(pa.table({"doc_id": pa.array(range(len(docs)), pa.int64()), "n_tokens": pa.array(list(map(len, docs)), pa.int64())}))
    return out.getvalue()


def test_files_over_many_blocks():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50_257, n).tolist() for n in (1, 150_000, 3, 65_536, 65_535, 1, 70_000)]
    raw = write(docs)
    at, rows = 0, [r for b in tokenbin.documents(io.BytesIO(raw), 7, True) for r in b.to_pylist()]
    for d, r in zip(docs, rows, strict=True):
        ids = np.array(d, "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (7 + at, len(d), zlib.crc32(ids), ids)
        at += len(d)
    with pytest.raises(ValueError):
        list(tokenbin.documents(io.BytesIO(raw[:-1]), 0, False))


def test_query_equals_the_library(spark, sf_dir):
    library, start = Tokenizer.from_file(JSON), 0
    rows = {r.doc_id: r for r in entry.op7_token_files(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(rows[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_edges(spark):
    d = brute.docs(spark, [None, "", "a<|endoftext|>b", "a<|endoftext|>b"])
    rows = tokenbin.token_file_report(d, JSON, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens) for r in rows] == [(0, 1), (1, 1), (2, 4), (6, 4)]
    assert tokenbin.token_file_report(d.limit(0), JSON, public_tokenizers.PATTERN).count() == 0
    files = tokenbin.write_tokens(d.selectExpr("nullif(doc_id, 2) as doc_id", "text", "'x' as ids"), JSON, public_tokenizers.PATTERN, folder=shared.scratch(spark, "t"))
    assert [(r.doc_id, len(r.ids) // 4) for r in files.read_ids(spark).orderBy("start").collect()] == [(None, 4), (0, 1), (1, 1), (3, 4)]
