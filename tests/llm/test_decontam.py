import hashlib
import re

from locusforge.llm import decontam, entry
from tests.llm import brute

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(text, items, n=10):
    words, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
    for item, passage in items:
        said = WORD.findall((passage or "").translate(LOWER))
        k = min(n, len(said))
        if k and item is not None:
            grams = {tuple(said[i : i + k]) for i in range(len(said) - k + 1)}
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


P = "One two, three four five six SEVEN eight nine ten eleven twelve"
ITEMS = [(3, P), (10, "short item"), (7, P), (2, None), (1, "!!"), (None, "zzz"), (5, "é-à ü"), (9, "one two three four five six seven eight nine ten")]
TEXTS = [None, "", "x " + P.lower().replace(",", " --"), "a short\nITEM b", P[:40], "É-à ü", "é à ü", "zzz", P + " y " + P, "two three four five six seven eight nine ten eleven", "w " * 40_000 + P, P]


def test_windows_equal_plain_search(spark):
    got = {r.doc_id: tuple(r)[1:] for r in decontam.find_contamination(brute.docs(spark, TEXTS), bench(spark, ITEMS)).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == plain(t, ITEMS), t and t[:60]


def test_blocks_of_a_larger_benchmark_agree(spark, monkeypatch):
    whole = sorted(map(tuple, decontam.find_contamination(brute.docs(spark, TEXTS), bench(spark, ITEMS)).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 1)
    assert sorted(map(tuple, decontam.find_contamination(brute.docs(spark, TEXTS), bench(spark, ITEMS)).collect())) == whole


def test_query_equals_plain_search(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = entry.op5_decontamination(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        assert tuple(r)[1:] == plain(docs[r.doc_id], items)


def test_spans_cover_what_is_hit(spark):
    r = decontam.find_contamination(brute.docs(spark, ["é " + P + " z"]), bench(spark, ITEMS[:1]), spans=True).first()
    assert [(h.start, h.end) for h in r.hits] == [(3, 3 + len(P))]


def test_empty_tables(spark):
    assert decontam.find_contamination(brute.docs(spark, TEXTS).limit(0), bench(spark, ITEMS)).count() == 0
    clean = decontam.find_contamination(brute.docs(spark, TEXTS), bench(spark, ITEMS).limit(0)).collect()
    assert len(clean) == len(TEXTS) and not any(r.contaminated for r in clean)
    assert clean[2].n_words == 13


def test_parts_of_an_item_have_all_its_windows():
    text = " ".join(f"W{i}," for i in range(57)).encode()
    words = [f"w{i}" for i in range(57)]
    for most in (1, 5, 48, 1000):
        got = [tuple(WORD.findall(p.decode().lower())) for _, p, _ in decontam.parts("x", text, 10, most)]
        assert [g[i : i + 10] for g in got for i in range(len(g) - 9)] == [tuple(words[i : i + 10]) for i in range(48)]
    assert [p for _, p, n in decontam.parts("x", b"!a b!", 10, 3)] == [b"a b"] and not list(decontam.parts("x", b"--", 10, 3))


def test_long_items_and_clashing_names(spark, monkeypatch):
    long = " ".join(f"v{i % 977}" for i in range(3000))
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 300)
    monkeypatch.setattr(decontam, "HELD_BYTES", 1000)
    items, texts = [*ITEMS, (77, long)], [*TEXTS, "x " + long + " y", *[P] * 20]
    docs = brute.docs(spark, texts).selectExpr("*", "1 as n_words", "'a' as item_id", "true as hits", "'b' as item")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.find_contamination(docs, bench(spark, items).selectExpr("*", "3 as item")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t, items), t and t[:60]
