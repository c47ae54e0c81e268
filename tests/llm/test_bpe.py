import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from locusforge.llm import bpe, entry, pretoken, tokenbin
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lay(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def odd_texts(n=2000, seed=3):
    r = random.Random(seed)
    alphabet = ["a", "b", "ab", "th", "the", "'s", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "1", "²", "é", "😀", "!", "-", "　", "١", "\x1c", "\x85", "<|endoftext|>"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(n)] + ["", "a" * 20_000, "ab" * 5000, " " * 3000, "\n" * 999 + "x"]


def test_pieces_equal_the_pattern():
    pattern, texts = regex.compile(public_tokenizers.PATTERN), odd_texts()
    assert pretoken.PATTERN == public_tokenizers.PATTERN
    data, off = lay(texts)
    start, before = pretoken.pieces(data, off)
    end, raw = np.append(start[1:], len(data)), data.tobytes()
    for i, t in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(start[before[i] : before[i + 1]], end[before[i] : before[i + 1]], strict=True)]
        assert got == pattern.findall(t), t[:60]


def test_pieces_equal_the_library_for_every_code_point(library):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    pattern = regex.compile(public_tokenizers.PATTERN)
    for c in random.Random(1).sample(points, 20_000) + [chr(i) for i in range(0x3100)]:
        text = f"a{c}1{c}!{c} b"
        assert library.encode_ordinary(text) == [t for p in pattern.findall(text) for t in library.encode_ordinary(p)]


def test_replay_equals_the_library(library):
    encoder, texts = bpe.Encoder(RANKS, public_tokenizers.PATTERN), odd_texts(seed=4)
    for _ in range(2):  # the second time from the cache
        ids, before = encoder.encode(*lay(texts))
        for i, t in enumerate(texts):
            one = ids[before[i] : before[i + 1]]
            assert one.tolist() == library.encode_ordinary(t), t[:60]
            assert encoder.decode(one) == t.encode()


def test_falling_ranks_and_other_patterns(tmp_path):
    """A vocabulary where a merge can bring up one of lower rank, against one merge at a time."""
    vocab = [bytes([i]) for i in range(256)] + [b"abc", b"bc", b"aa", b"ab", b"aaa", b"abab", b"cc", b"bcc"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(v) + b" " + str(i).encode() for i, v in enumerate(vocab)))
    own = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks={v: i for i, v in enumerate(vocab)}, special_tokens={})
    encoder, r = bpe.Encoder(str(path), r"\S+|\s+"), random.Random(2)
    texts = ["".join(r.choice("aabbcc ") for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    ids, before = encoder.encode(*lay(texts))
    for i, t in enumerate(texts):
        assert ids[before[i] : before[i + 1]].tolist() == own.encode_ordinary(t), t


def test_alike_words_in_one_batch_and_from_the_cache(library):
    """Words whose polynomial hashes meet, whatever the base."""
    one, two = brute.thue_morse(1024)
    encoder, pieces = bpe.Encoder(RANKS, public_tokenizers.PATTERN), tokenbin.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for texts in ([one], [two], [one, two], [f"{two} {one}", one]):
        for e in (encoder, pieces):
            ids, before = e.encode(*lay(texts))
            assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:], strict=True)] == [library.encode_ordinary(t) for t in texts]


def test_query_and_edges(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in entry.op4_byte_level_bpe(spark, sf_dir).collect():
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    d = brute.docs(spark, [None, "", "x", "x"]).withColumnRenamed("lang", "ids")
    rows = bpe.encode_decode(d, RANKS, public_tokenizers.PATTERN, ids=True).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [0, 0, 1, 1] and bytes(rows[0].ids) == b""
    assert bpe.encode_decode(d.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_piece_encoder_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), odd_texts(seed=5)
    for pattern in (public_tokenizers.PATTERN, "another"):
        encoder = tokenbin.PieceEncoder(path, pattern)
        ids, before = encoder.encode(*lay(texts))
        for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[before[i] : before[i + 1]].tolist() == e.ids, texts[i][:60]


def test_workers_keep_no_pieces_between_tasks(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts(n=200))], "doc_id long, text string").coalesce(1)
    assert bpe.encode_decode(d, RANKS, public_tokenizers.PATTERN).where("n_tokens > 0").count()

    def held(batches):
        from locusforge.llm import bpe

        for b in batches:
            yield pa.record_batch([pa.array([sum(len(e.pairs) + len(e.young) + len(e.old) for e in bpe._LOADED.values())]), pa.array([len(bpe._LOADED)])], ["kept", "loaded"])

    got = spark.range(64, numPartitions=8).mapInArrow(held, "kept long, loaded long").collect()
    assert sum(r.loaded for r in got) and not sum(r.kept for r in got)
