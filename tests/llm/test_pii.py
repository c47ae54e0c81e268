from pyspark.sql import functions as F

from locusforge.llm import pii
from tests.llm import brute


def test_base_spans_equal_plain_matching(spark):
    texts = brute.noisy_texts(1500)
    got = {r.doc_id: r for r in pii.pii_report(brute.docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute.pii_spans(text)
        listed = [f"{k}:{s}:{e}" for k, s, e in want]
        assert got[i].base_sha256 == brute.sha(listed), (text, want, got[i].spans)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == x for k, *_ in want) for x in pii.BASE]
        assert ",".join(x for x in got[i].spans.split(",") if x.split(":")[0] in pii.BASE) == ",".join(listed)


def test_checksums_and_context_decide_on_more_kinds(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "GB82WEST12345698765433", "ssn 078-05-1120", "part 078-05-1120", "DE89370400440532013000", "DE89370400440532013000 BIC COBADEFFXXX", "GB82 WEST 1234 5698 7654 32 UK 5", "XX82 WEST 1234 5698 7654 32"]
    got = [r.spans for r in pii.pii_report(brute.docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["iban:5:32", "", "ssn:4:15", "", "iban:0:22", "iban:0:22", "iban:0:27", ""]
    scores = [r.pii[0].score for r in pii.find_pii(brute.docs(spark, [texts[0], texts[4]])).orderBy("doc_id").collect()]
    assert scores == [1.0, 0.8]


def test_redaction_replaces_spans_and_keeps_columns(spark):
    d = brute.docs(spark, ["é mail a@b.com, ip 10.0.0.1!", None, "clean"]).withColumn("pii", F.lit("clash")).withColumn("LF_spans", F.lit("too"))
    out = pii.redact_pii(d)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "pii", "LF_spans"]
    rows = out.orderBy("doc_id").collect()
    assert {(r.pii, r.LF_spans) for r in rows} == {("clash", "too")}
    assert [r.text for r in rows] == ["é mail <EMAIL>, ip <IP>!", None, "clean"]
    assert rows[0].n_chars == len(rows[0].text)
    again = pii.pii_report(d)  # a column of that name in the input doesn't get in the way
    assert again.where("n_email = 1").count() == 1


def test_overlaps_are_replaced_once_and_empty_tables_work(spark):
    d = brute.docs(spark, ["+4111 1111 1111 1111 x 4111111111111111"])
    assert "4111" not in pii.redact_pii(d).first().text
    assert pii.pii_report(d.limit(0)).count() == 0
    assert pii.redact_pii(d.limit(0)).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = pii.pii_report(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
