"""Raw documents to token ids, in five stages; each works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and reads
it for the next. All but the last return the columns of documents. Verdicts are
those of a text under its id: rows with null ids and repeated ids meet them by a null-safe key and the digest of the
text. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm import bpe, decontam, neardup, pii, quality, shared


def _digested(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with the digest of their text, which operators carry along, and its name."""
    name = shared.fresh(docs, "lf_text")
    return docs.withColumn(name, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))), name


def _met(docs: DataFrame, verdict: DataFrame, name: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(the documents with null-safe keys, the keys of the verdict's rows, their names)."""
    docs, text = _digested(docs)
    key = shared.fresh(docs, "lf_key")
    return docs.withColumn(key, shared.key_text("doc_id")), shared.materialize(verdict.select(shared.key_text("doc_id").alias(key), text).distinct(), name), [key, text]


def _keep(docs: DataFrame, verdict: DataFrame, name: str) -> DataFrame:
    """The documents whose id and text aren't among those turned down; rows that repeat both share the verdict.

    Texts stay where they are, but for those that a filter of fixed size can't tell from the ones to drop.
    """
    return shared.without(*_met(docs, verdict, name)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go."""
    keyed, text = _digested(docs)
    verdict = quality.quality_rules(keyed, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(text,))
    return _keep(docs, verdict.where(~F.col("kept")), "rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id; of rows that repeat id and text, one does."""
    keyed, text = _digested(docs)
    verdict = shared.materialize(neardup.near_duplicates(keyed, carry=(text,)), "verdict")
    out = _keep(docs, verdict.where(~F.col("kept")), "copies")
    again = verdict.where("kept").groupBy("doc_id", text).count().where("count > 1")
    rows, keys, on = _met(out, again, "repeats")
    once, others = shared.sieve(rows, keys, on)
    return once.union(others.dropDuplicates(on)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    keyed, text = _digested(docs)
    found = decontam.find_contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=(text,))
    return _keep(docs, found.where("contaminated"), "contaminated")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return pii.redact_pii(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the decoded bytes."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_level_bpe", byte_level_bpe),
]

#: Forests, hashing and BPE can't be put as SQL; tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), name)
    return docs
