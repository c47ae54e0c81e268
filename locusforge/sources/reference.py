"""A stored dictionary of reference variants: sorted Parquet by chromosome with a dense index, and an index of rsIDs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import builds
from ..operators import harmonise, select
from ..operators.rowid import with_row_id
from . import files

FORMAT, VERSION = "locusforge-reference", 1
COLUMNS = ["chromosome", "base_pair_location", "reference_allele", "alternate_allele", "rsids", "ref_eaf", "variant_type", "idx"]


@dataclass
class Reference:
    spark: SparkSession
    path: str
    manifest: dict

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.manifest["schema"]).parquet(f"{self.path}/values").select(*COLUMNS)

    def query(self, region: tuple[str, int, int] | None = None, rsids: Iterable[str] | None = None, keys: Iterable[str] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
        """Variants that meet all that is given. Regions, places of keys and rows (first and last index) reach the scan; names go through their index."""
        out = harmonise.reference_query(self.table(), region, None, list(keys) if keys is not None else None)
        if rows is not None:
            out = out.where(F.col("idx").between(*rows))
        if rsids is not None:
            asked = sorted({r.lower() for r in rsids})
            named = self.spark.read.parquet(f"{self.path}/rsids")
            named = named.where(F.col("rsid").isin(asked)) if len(asked) <= 1000 else named.join(select.sized(self.spark.createDataFrame([(r,) for r in asked], "rsid string")), "rsid", "left_semi")
            out = out.join(named.select("chromosome", "idx").distinct(), ["chromosome", "idx"], "left_semi")
        return out

    def validate(self) -> dict:
        """Indexes dense, unique and in genome order; digests of all files."""
        files.check_payload(self.spark, self.path, self.manifest)
        total = self.table().agg(F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.count_distinct("idx").alias("ids")).first()
        n = self.manifest["n_rows"]
        if (total.n, total.ids) != (n, n) or (n and (total.low, total.high) != (0, n - 1)):
            raise files.StoreError("rows of the reference are missing or repeat")
        return {"valid": True, "n_rows": n}


def write_reference(df: DataFrame, path: str, build: str = "GRCh38", snv_only: bool = False, overwrite: bool = False) -> Reference:
    spark = df.sparkSession
    staged = files.staging(spark, path, overwrite)
    order = F.array_position(F.array(*map(F.lit, builds.CHROMOSOMES)), F.col("chromosome")).cast("int")
    known = harmonise.canonical_reference(df, snv_only).withColumn("_order", order).where("_order > 0")
    numbered = with_row_id(known, ["_order", "base_pair_location", "reference_allele", "alternate_allele"], "idx").drop("_order").select(*COLUMNS)
    numbered.sortWithinPartitions("chromosome", "idx").write.option("compression", "zstd").partitionBy("chromosome").parquet(f"{staged}/values")
    names = numbered.select(F.explode(F.split("rsids", ";")).alias("rsid"), "chromosome", "idx").where("rsid <> ''").withColumn("rsid", F.lower("rsid"))
    names.repartitionByRange("rsid").sortWithinPartitions("rsid").write.option("compression", "zstd").parquet(f"{staged}/rsids")
    n = numbered.count()
    if not n:
        raise files.StoreError("the reference has no valid variants")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    manifest = files.seal(spark, staged, {"format": FORMAT, "version": VERSION, "build": builds.normalize_build(build), "n_rows": n, "schema": schema})
    files.commit(spark, staged, path)
    return Reference(spark, path, manifest)


def open_reference(spark: SparkSession, path: str) -> Reference:
    return Reference(spark, path, files.open_manifest(spark, path, FORMAT, VERSION))
