"""Variant panels: identities with an HapMap3 flag, as Parquet, PLINK, delimited files or chromosome shards."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import builds, identity
from ..operators.resolve import alias_hits
from ..operators.rowid import with_row_id
from . import delimited, files, store

FORMAT, VERSION = "locusforge-panel", 1
ALIASES = {"common": "core", "tag": "core", "core": "core", "hm3": "hm3"}


@dataclass
class Panel:
    spark: SparkSession
    path: str
    manifest: dict

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.manifest["schema"]).parquet(f"{self.path}/values")

    def read(self, chromosomes: Iterable[str] | None = None, rows: Iterable[int] | None = None, keys: Iterable[str] | None = None, hm3_only: bool = False) -> DataFrame:
        """variant_id, chromosome, base_pair_location, reference_allele, alternate_allele, hm3 in genome order. rows count from one."""
        out = self.table()
        if chromosomes is not None:
            out = out.where(F.col("chromosome").isin([str(c) for c in chromosomes]))
        if rows is not None:
            wanted = sorted(set(rows))
            if wanted and (wanted[0] < 1 or wanted[-1] > self.manifest["n_rows"]):
                raise ValueError("panel rows count from one to the count of rows")
            out = out.where(F.col("row").isin(wanted))
        if keys is not None:
            given = self.spark.createDataFrame([(str(k),) for k in set(keys)], "variant_id string")
            code = identity.parse_key(F.col("variant_id"))
            codes = given.select(identity.variant_code(code["chromosome"], code["position"], code["reference"], code["alternate"], self.manifest["build"]).alias("variant_code"))
            out = out.join(F.broadcast(codes), "variant_code", "left_semi")  # as many as the caller listed
        if hm3_only:
            out = out.where("hm3")
        reference, alternate = identity.decode_alleles(F.col("substitution"))
        out = out.withColumn("reference_allele", reference).withColumn("alternate_allele", alternate)
        key = identity.variant_key(F.col("chromosome"), F.col("base_pair_location"), F.col("reference_allele"), F.col("alternate_allele"))
        return out.orderBy("variant_code").select(key.alias("variant_id"), "chromosome", "base_pair_location", "reference_allele", "alternate_allele", "hm3", "variant_code")

    def validate(self) -> dict:
        total = self.table().agg(F.count("*").alias("n"), F.count_distinct("variant_code").alias("codes"), F.sum(F.col("hm3").cast("long")).alias("hm3")).first()
        if total.n != self.manifest["n_rows"] or total.codes != total.n or (total.hm3 or 0) != self.manifest["n_hm3"]:
            raise files.StoreError("the panel's rows don't match its manifest")
        files.check_payload(self.spark, self.path, self.manifest)
        return {"valid": True, "n_rows": total.n, "n_hm3": total.hm3 or 0}


def canonical(df: DataFrame, build: str = "GRCh38") -> DataFrame:
    """variant_code and parts from columns where they are given, else from the id; a contradiction raises."""
    k = identity.parse_key(F.col("variant_id")) if "variant_id" in df.columns else F.lit(None).cast("struct<chromosome:string,position:bigint,reference:string,alternate:string>")
    has = {"chromosome", "base_pair_location", "reference_allele", "alternate_allele"} <= set(df.columns)
    if has:
        own = identity.variant_code(identity.normalize_chromosome(F.col("chromosome")), F.col("base_pair_location").try_cast("long"), F.upper("reference_allele"), F.upper("alternate_allele"), build)
    else:
        own = F.lit(None).cast("long")
    by_id = identity.variant_code(k["chromosome"], k["position"], k["reference"], k["alternate"], build)
    code = F.when(own.isNotNull() & by_id.isNotNull() & (own != by_id), F.raise_error(F.lit("a panel id contradicts its coordinates")).cast("long")).otherwise(F.coalesce(own, by_id))
    hm3 = F.coalesce(F.col("hm3").cast("int") == 1, F.lit(False)) if "hm3" in df.columns else F.lit(False)
    out = df.select(code.alias("variant_code"), hm3.alias("hm3")).where("variant_code is not null")
    place = (F.col("variant_code") / 16).cast("long")
    chromosome, position = identity.decode_position(place, build)
    merged = out.groupBy("variant_code").agg(F.max("hm3").alias("hm3"))
    return merged.withColumn("global_position", place).withColumn("substitution", F.col("variant_code").bitwiseAND(15).cast("tinyint")).withColumn("chromosome", chromosome).withColumn("base_pair_location", position.cast("long"))


def write_panel(df: DataFrame, path: str, build: str = "GRCh38", overwrite: bool = False) -> Panel:
    spark = df.sparkSession
    staged = files.staging(spark, path, overwrite)
    rows = with_row_id(canonical(df, build), ["variant_code"], "row", first=1).select("chromosome", "row", "base_pair_location", "global_position", "substitution", "variant_code", "hm3")
    n = rows.agg(F.count("*").alias("n"), F.sum(F.col("hm3").cast("long")).alias("h")).first()
    if not n.n:
        raise files.StoreError("the panel has no valid variants")
    store._write(rows, f"{staged}/values")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    manifest = files.seal(spark, staged, {"format": FORMAT, "version": VERSION, "build": builds.normalize_build(build), "n_rows": n.n, "n_hm3": n.h or 0, "schema": schema})
    files.commit(spark, staged, path)
    return Panel(spark, path, manifest)


def open_panel(spark: SparkSession, path: str) -> Panel:
    return Panel(spark, path, files.open_manifest(spark, path, FORMAT, VERSION))


def read_any(spark: SparkSession, source: str | DataFrame, build: str = "GRCh38", chromosomes: Iterable[str] | None = None) -> DataFrame:
    """A canonical panel from a DataFrame, a panel or store, a folder of shards, PLINK .bim, Parquet, or a delimited file."""
    if isinstance(source, DataFrame):
        return canonical(_named(source), build)
    if files.exists(spark, f"{source}/manifest.json"):
        import json

        kind = json.loads(files.read_text(spark, f"{source}/manifest.json"))["format"]
        if kind == FORMAT:
            return open_panel(spark, source).table().drop("row")
        return store.open_store(spark, source).table().select("variant_code", F.lit(False).alias("hm3"), "global_position", "substitution", "chromosome", "base_pair_location")
    base = re.sub(r"(?i)\.(gz|bz2|zst|bgz|xz)$", "", source)
    if base.endswith(".bim"):
        cols = F.split(F.regexp_replace(F.trim("value"), r"\s+", "\t"), "\t")
        return canonical(delimited.lines(spark, source).where("trim(value) <> ''").select(cols[0].alias("chromosome"), cols[3].try_cast("long").alias("base_pair_location"), cols[5].alias("reference_allele"), cols[4].alias("alternate_allele")), build)
    if source.rstrip("/").endswith(".parquet"):
        return canonical(_named(spark.read.parquet(source)), build)
    shards = shard_paths(spark, source, chromosomes)
    if shards:
        parts = [_named(delimited.read_delimited(spark, p)) for p in shards]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return canonical(out, build)
    return canonical(_named(delimited.read_delimited(spark, source)), build)


def _named(df: DataFrame) -> DataFrame:
    hits = alias_hits(df.columns)
    hits["hm3"] = [c for c in df.columns if c.lower() == "hm3"]
    picked = {t: hits[t][0] for t in ("variant_id", "chromosome", "base_pair_location", "reference_allele", "alternate_allele", "effect_allele", "other_allele", "rsid", "hm3") if hits.get(t)}
    if "reference_allele" not in picked and "other_allele" in picked:
        picked["reference_allele"], picked["alternate_allele"] = picked["other_allele"], picked["effect_allele"]
    if not picked:
        picked = {"variant_id": df.columns[0]}
    return df.select(*(F.col(f"`{c}`").alias(t) for t, c in picked.items()))


def shard_paths(spark: SparkSession, folder: str, chromosomes: Iterable[str] | None = None) -> list[str]:
    """chr<name>.tsv files, plain or gzipped, in genome order, in the folder or its by_chrom; only those asked for."""
    wanted = [str(c) for c in chromosomes] if chromosomes is not None else builds.CHROMOSOMES
    out = []
    for c in builds.CHROMOSOMES:
        if c in wanted:
            tries = [f"{folder}/{sub}chr{c}.tsv{end}" for sub in ("", "by_chrom/") for end in ("", ".gz")]
            out += [p for p in tries if files.exists(spark, p)][:1]
    return out


def resolve_name(request: str, environ: dict[str, str] | None = None) -> tuple[str, str | None]:
    """(path, pinned digest) of a named panel: name, or name@sha256:<hex>; from LOCUSFORGE_<NAME>_PANEL or LOCUSFORGE_PANEL_DIR/<name>."""
    environ = os.environ if environ is None else environ
    name, _, pin = request.partition("@sha256:")
    if pin and not re.fullmatch("[0-9a-fA-F]{64}", pin):
        raise ValueError("a pinned digest has 64 hexadecimal digits")
    key = ALIASES.get(name.lower())
    if key is None:
        raise ValueError(f"unknown panel {name!r}")
    path = environ.get(f"LOCUSFORGE_{key.upper()}_PANEL") or (f"{environ['LOCUSFORGE_PANEL_DIR']}/{key}" if "LOCUSFORGE_PANEL_DIR" in environ else None)
    if path is None:
        raise FileNotFoundError(f"panel {name!r}: set LOCUSFORGE_{key.upper()}_PANEL or LOCUSFORGE_PANEL_DIR")
    return path, pin.lower() or environ.get(f"LOCUSFORGE_{key.upper()}_PANEL_SHA256")


def verify_pin(spark: SparkSession, path: str, pin: str | None) -> str:
    """The digest of a panel file, or of a panel folder's manifest; with a pin it has to be that."""
    manifest = f"{path}/manifest.json"
    found = files.hashes(spark, [manifest if files.exists(spark, manifest) else path])[0]
    if pin and found != pin.lower():
        raise files.StoreError(f"{path} doesn't have the pinned digest")
    return found


def named(spark: SparkSession, request: str, build: str = "GRCh38", environ: dict[str, str] | None = None) -> tuple[DataFrame, dict]:
    """(canonical panel, where it comes from) of a panel by name, or of a path that anything of read_any lies at."""
    path, pin = (request, None) if "/" in request else resolve_name(request, environ)
    if files.exists(spark, f"{path}/manifest.json") or not shard_paths(spark, path):
        digest = verify_pin(spark, path, pin) if files.is_file(spark, path) or files.exists(spark, f"{path}/manifest.json") else None
    else:
        digest = None
    if pin and digest is None:
        raise files.StoreError(f"{path} is a folder of files, which a pin doesn't name")
    return read_any(spark, path, build), {"panel": request, "path": path, "sha256": digest, "pinned": bool(pin)}
