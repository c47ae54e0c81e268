"""A summary-statistics study derived from the driver's lineitem table, with defects, in SQL that two engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import finite
from ..operators import qc, rowid
from ..sources import files, scratch

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# From an ordinal and the item's columns to a study.
_BODY = """
s AS (
  SELECT ordinal, ri, ai,
         CASE WHEN h = 99 THEN 'MT' WHEN h = 98 THEN 'chr23' WHEN h % 24 < 22 THEN CAST(h % 24 + 1 AS STRING)
              WHEN h % 24 = 22 THEN 'X' ELSE 'Y' END AS chromosome,
         CASE WHEN ordinal % 997 = 0 THEN NULL WHEN ordinal % 991 = 0 THEN 0
              ELSE 1 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 613) % 2000000 END AS base_pair_location,
         CASE WHEN ordinal % 487 = 0 THEN 'N' WHEN ordinal % 389 = 0 THEN 'AT' ELSE substr('ACGT', ri + 1, 1) END AS reference_allele,
         CASE WHEN ordinal % 373 = 0 THEN substr('ACGT', ri + 1, 1) ELSE substr('ACGT', ai + 1, 1) END AS alternate_allele,
         CASE WHEN ordinal % 509 = 0 THEN NULL ELSE (l_discount - 0.05e0) * (l_extendedprice / 1e5) * (1e0 + l_tax) END AS beta,
         CASE WHEN ordinal % 503 = 0 THEN 0e0 ELSE 0.009e0 + l_tax / 10e0 + l_quantity / 1e4 END AS standard_error,
         CASE WHEN ordinal % 521 = 0 THEN 1.2e0 WHEN l_quantity = 13 THEN NULL ELSE l_quantity / 51e0 END AS effect_allele_frequency,
         CASE WHEN ordinal % 523 = 0 THEN -1e0 WHEN ordinal % 3000 = 0 THEN 1e-9 WHEN ordinal % 4500 = 0 THEN 1e-5
              WHEN ordinal % 3 = 0 THEN (l_quantity / 51e0) * (5e-2 + l_discount) ELSE NULL END AS p_value
  FROM l),
g AS (
  SELECT ordinal, chromosome, base_pair_location, reference_allele, alternate_allele,
         CASE WHEN ordinal % 211 = 0 THEN reference_allele ELSE alternate_allele END AS effect_allele,
         CASE WHEN ordinal % 211 = 0 THEN alternate_allele ELSE reference_allele END AS other_allele,
         beta, standard_error, effect_allele_frequency, p_value
  FROM s
  UNION ALL
  SELECT ordinal + 1000000000, chromosome, base_pair_location, reference_allele, alternate_allele,
         alternate_allele, reference_allele, beta, standard_error, effect_allele_frequency, p_value
  FROM s WHERE ordinal % 101 = 0)"""
_ITEM = """SELECT {ordinal} AS ordinal, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax,
         (l_partkey * 31 + l_suppkey * 17 + l_orderkey) % 100 AS h,
         CAST(l_partkey % 4 AS INT) AS ri, CAST((l_partkey % 4 + 1 + l_suppkey % 3) % 4 AS INT) AS ai
  FROM {source}"""
#: For an engine that holds all rows in one place: rows numbered by one window.
VIEW_SQL = "l AS (" + _ITEM.format(ordinal=f"CAST(row_number() OVER (ORDER BY {', '.join(ORDER)}) AS BIGINT)", source="lineitem") + ")," + _BODY

_MADE: dict[tuple[str, str, str, str], DataFrame] = {}


def stamp(spark: SparkSession, sf_dir: str) -> str:
    """Changes when the table that the study is derived from does."""
    return files.stamp(spark, f"{sf_dir}/lineitem.parquet")


def _made(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Derived tables are written once a session, folder and state of its files; queries start from them as from an ingested study."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir), name)
    if key not in _MADE:
        _MADE[key] = scratch.materialize(build(), name)
    return _MADE[key]


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw study; ordinals are dealt by range, not by a sort in one task."""

    def build() -> DataFrame:
        items = rowid.with_row_id(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER), ORDER, "_n", first=1)
        item = _ITEM.format(ordinal="_n", source="{items}")
        return spark.sql(f"WITH l AS ({item}),{_BODY} SELECT * FROM g", items=items)

    return _made(spark, sf_dir, "study", build)


def with_z(df: DataFrame) -> DataFrame:
    beta, se = F.col("beta"), F.col("standard_error")
    return df.withColumn("z", F.when(finite(beta) & finite(se) & (se > 0), beta / se))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study with z, reasons and the verdict of QC."""
    return qc.with_reasons(with_z(study(spark, sf_dir)))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows in canonical form."""
    return _placed(spark, sf_dir).drop("_range", "_at")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows with their row_id."""
    return rowid.numbered(_placed(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows, dealt by their codes once: copies meet there, and the order is that of row ids."""

    def build() -> DataFrame:
        dealt = qc.group_key(study(spark, sf_dir)).repartitionByRange("_group")
        kept = qc.canonicalize(qc.with_reasons(with_z(dealt)).where("kept").drop("reasons", "kept"))
        return rowid.placed(kept.sortWithinPartitions("variant_code"))

    return _made(spark, sf_dir, "prepared", build)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 40th row's variant, of which every fourth is in hm3."""
    return prepared(spark, sf_dir).where("ordinal % 40 = 0").select("variant_code", (F.col("ordinal") % 160 == 0).alias("hm3"))
