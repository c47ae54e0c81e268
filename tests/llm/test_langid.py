from zlib import crc32

import xxhash
import zstandard
from locusforge.llm import entry, langid
from tests.llm import brute


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = entry.op3_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    sure = [r for r in held if not r.rejected]
    assert sum(r.lang_pred == lang[r.doc_id] for r in sure) / len(sure) > 0.98


def test_nothing_is_learned_from_held_out_rows_and_lang_is_no_input(spark):
    docs = brute.docs(spark, [f"der hund und die katze {i}" for i in range(40)])
    tagged = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz' else 'de' end as lang")
    assert {r.lang_pred for r in langid.identify_language(tagged).collect()} == {"de"}
    other = tagged.selectExpr("doc_id", "text", "case when doc_id < 5 then 'de' end as lang")
    assert {r.lang_pred for r in langid.identify_language(other).collect()} == {"de"}


def test_edges(spark):
    texts = [None, "", "123 !!", "the cat and the dog", "é", "the " * 60_000, "the cat and the dog"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(brute.docs(spark, texts)).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert all(got[i][0] == "en" for i in range(3, 7)) and got[3] == got[6]
    empty = brute.docs(spark, texts).limit(0)
    assert langid.identify_language(empty).count() == 0
    nothing = brute.docs(spark, texts).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify_language(nothing).collect()} == {"und"}


def plain_learn(rows, sample_rows, size):
    """(lang, text) rows -> {lang: dictionary}, by whole lists."""
    out = {}
    for lang in {k for k, _ in rows}:
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        texts = {t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) for k, t in rows if k == lang}
        first = sorted(texts, key=lambda t: (texts[t] % (1 << 30), texts[t]))[:sample_rows]
        raws = [langid.letters(t) for t in first]
        parts, whole = {(xxhash.xxh64_intdigest(p), p) for r in raws for p in (r[i : i + 1024] for i in range(0, len(r), 1024))}, []
        for _, p in sorted(parts):
            if sum(map(len, whole)) < size:
                whole.append(p)
        out[lang] = b"\n".join(whole)[:size]
    return out


def test_learning_and_predicting_equal_a_plain_version(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text is not None]
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, 1, "x") for r in rows], "doc_id long, text string, lang string, h int, u string")
    known = [(r.lang, r.text) for r in rows if r.lang is not None and crc32(str(r.doc_id).encode()) % 4 != 2]
    want = plain_learn(known, 40, 30_000)
    got = langid.learn(docs, sample_rows=40, dictionary_bytes=30_000)
    assert dict(got) == want
    counts = [sum(k == lang for k, _ in known) for lang, _ in got]
    assert counts == sorted(counts, reverse=True)
    tool = langid.Classifier(got)
    for r in rows[:150]:
        raw = langid.letters(r.text)
        sizes = {}
        for lang, data in got:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid.LEVEL)
            packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False)
            sizes[lang] = sum(len(packer.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
        lang, score = tool.predict(r.text)
        if not raw:
            assert (lang, score) == ("und", 0.0)
            continue
        best, second = sorted(sizes.values())[:2]
        assert sizes[lang] == best and lang == next(k for k, _ in got if sizes[k] == best) and abs(score - (1 - best / second)) < 1e-12


def test_only_the_most_frequent_languages_are_learned(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", f"l{i // 20 if i < 100 else i}") for i in range(160)], "doc_id long, text string, lang string")
    got = langid.learn(docs, languages=5, sample_rows=3)
    assert sorted(k for k, _ in got) == [f"l{i}" for i in range(5)]


def test_ties_go_to_the_language_with_more_rows(spark):
    rows = [(4 * i + j, "same words here", lang) for i, lang in enumerate(["b", "a", "b", "a", "b", "c"]) for j in range(4)]
    assert {r.lang_pred for r in langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"b"}
