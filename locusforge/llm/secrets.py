"""Secret scans over an incremental blob ledger. Columns only.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds one row for each blob and rule
version that was scanned, with its findings. A scan addresses all paths, scans the blobs that the ledger lacks for the
current rules once each, appends them, and joins findings back to all paths.

Edge cases: null and empty texts share the blob of the empty text; repeated rows and shared blobs are scanned once
and reported for each row; null ids are kept; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import spans as S

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
# A run that is too short at its start is too short further on, so that lengths can be part of the patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
MORE = {
    "private_key": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "-----BEGIN"),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36}", "gh"),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}+", "xox"),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
}
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, *MORE]
#: Part of the ledger's key: new rules scan all blobs again, beside the findings of old ones.
RULES = "1"


def spans_of(text: Column) -> Column:
    """All spans by start, then kind."""
    found = [
        S.kept(S.matches(text, ASSIGN), "assign", lambda x: F.length(F.regexp_extract(x, ASSIGN_VALUE, 1)) >= 8),
        S.kept(S.matches(text, ACCESS, "AKIA"), "access"),
        S.kept(S.matches(text, HEX), "hex"),
        *(S.kept(S.matches(text, p, needs), kind) for kind, (p, needs) in MORE.items()),
    ]
    return S.by_start(F.concat(*found), KINDS)


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, a never-null form of it, and the blob of its text."""
    return docs.select("doc_id", shared.key_text("doc_id").alias("path"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("blob"))


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: str = RULES) -> tuple[DataFrame, str]:
    """(doc_id and secrets for each row, path of the ledger). Without a ledger a new one is begun in the shared folder."""
    spark = docs.sparkSession
    ledger = ledger or shared.scratch(spark, "ledger")
    paths = shared.materialize(addressed(docs), "paths")
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if shared.exists(spark, ledger):
        blobs = blobs.join(spark.read.parquet(ledger).where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    unseen = shared.materialize(blobs, "unseen")
    rows = docs.select(shared.key_text("doc_id").alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    spare = shared.materialize(paths.select("path", "blob").join(unseen, ["path", "blob"], "left_anti").distinct(), "spare")
    todo = shared.without(rows, spare, ["path", "blob"])  # one row at least of each unseen blob
    fresh = todo.select("blob", spans_of(F.col("text")).alias("secrets")).dropDuplicates(["blob"]).withColumn("rules", F.lit(rules))
    fresh.write.mode("append").parquet(ledger)
    found = spark.read.parquet(ledger).where((F.col("rules") == rules) & (F.size("secrets") > 0)).select("blob", "secrets").dropDuplicates(["blob"])
    joined = shared.join_spread(paths.select("doc_id", "blob"), found, "blob", "left")
    return joined.select("doc_id", F.coalesce("secrets", F.array().cast(S.SPANS)).alias("secrets")), ledger


def secrets_report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, counts of base kinds, digest of the base spans, all spans."""
    found, _ = scan_secrets(docs, ledger)
    base = F.filter("secrets", lambda x: x["kind"].isin(BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(S.listed(base), 256).alias("base_sha256"), S.listed(F.col("secrets")).alias("spans"))
