import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from locusforge.llm import bpe, quality
from tests.llm import brute
from tests.llm.test_decontam import plain as contaminated
from tests.llm.test_neardup import plain as grouped


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage was given and returned."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.shared.materialize(stage(spark, docs, sf_dir), name)
        out.append((name, before, docs))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "byte_level_bpe"]
    assert all(after.schema.names == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, after in stages[:-1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_stage_drops_what_the_rules_reject(spark, sf_dir, stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in quality.quality_rules(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").collect()}
    assert set(rows(after)) == kept and 0 < len(kept) < before.count()


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[1]
    want = grouped({i: r.text for i, r in rows(before).items()})
    assert set(rows(after)) == {i for i, (_, c) in want.items() if i == c}


def test_contaminated_documents_go_and_clean_ones_stay(spark, sf_dir, stages):
    _, before, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(rows(after)) == {i for i, r in rows(before).items() if not contaminated(r.text, items)[4]}


def test_personal_data_is_gone_and_the_rest_unchanged(stages):
    _, before, after = stages[3]
    now, changed = rows(after), 0
    for i, r in rows(before).items():
        spans = brute.pii_spans(r.text)
        changed += bool(spans)
        assert not brute.pii_spans(now[i].text)
        if not spans:
            assert now[i].text == r.text
        assert now[i].n_chars == len(now[i].text)
    assert changed


def test_tokens_are_those_of_the_redacted_texts(stages):
    _, before, after = stages[4]
    encoder, got = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), rows(after)
    assert set(got) == set(rows(before))
    for i, r in rows(before).items():
        assert encoder.decode(np.frombuffer(got[i].ids, "<u4")) == r.text.encode()
        assert got[i].ids_sha256 == hashlib.sha256(got[i].ids).hexdigest() and got[i].n_tokens * 4 == len(got[i].ids)


def test_verdicts_are_of_a_text_and_not_of_all_rows_of_its_id(spark, sf_dir):
    good = lambda k: " ".join(f"{k}word{i}" for i in range(60))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id is not null and length(text) > 100").first().text
    leak = f"{good('l')} {item}"

    def left(stage, data):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], brute.SCHEMA)
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, sf_dir).collect()), key=repr)

    fine = [(None, good("a")), (None, good("b")), (7, good("c"))]
    assert left(corpus_pipeline.quality_rules, [*fine, (None, "too short"), (7, "short as well")]) == sorted(fine, key=repr)
    assert left(corpus_pipeline.decontamination, [*fine, (None, leak), (7, leak)]) == sorted(fine, key=repr)
    assert left(corpus_pipeline.near_duplicates, [*fine, (1, good("d")), (None, good("d"))]) == sorted([*fine, (1, good("d"))], key=repr)


def test_odd_rows_and_empty_tables_pass_through(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text + " one", "en", None, None), (1, None, None, None, None), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (3, text + " a@b.com", None, None, None)], brute.SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.shared.materialize(stage(spark, docs, sf_dir), name)
    assert docs.count() == 2  # a row without id, whose class has no name to be linked by, and one of the copies
    for name, stage in corpus_pipeline.STAGES:
        empty = spark.createDataFrame([], brute.SCHEMA)
        assert stage(spark, empty, sf_dir).count() == 0
