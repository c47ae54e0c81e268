"""The quantised store: sorted Parquet by chromosome, a manifest, and reads by region, key, row and column."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import builds, identity
from ..functions.observe import Observer
from ..operators import codec, select
from ..operators.rowid import VALUE_BLOCK, with_row_id
from . import files
from .files import StoreError

FORMAT, VERSION = "locusforge-store", 1
DEFAULT_COLUMNS = ["chromosome", "base_pair_location", "effect_allele", "other_allele", "beta", "standard_error", "z", "effect_allele_frequency", "p_value"]
COLUMNS = [*DEFAULT_COLUMNS, "reference_allele", "alternate_allele", "variant_id", "variant_code", "global_position", "substitution", "row_id", "block_id", "pvalue_flag"]
CODES = ["row_id", "block_id", "base_pair_location", "global_position", "substitution", "variant_code", "z_code", "eaf_code", "se_code", "se_centre", "exc_flags", "exc_z", "exc_log2se", "exc_eaf", "pvalue_flag"]
EXACT = ["row_id", "block_id", "base_pair_location", "global_position", "substitution", "variant_code", "z", "standard_error", "effect_allele_frequency", "pvalue_flag"]
Q8 = codec.Profile("q8", z_bins=254, z_upper_inclusive=True, eaf_steps=254, eaf_missing=255, se_bins=254)
PROFILES = {p.name: p for p in (codec.NATIVE, codec.LEGACY, Q8)}


def parse_region(region: str | tuple) -> tuple[str, int, int]:
    """chr1:100-200, 1:100-200, or (chromosome, start, end); both ends are inside."""
    if isinstance(region, str):
        m = re.fullmatch(r"(?i)(?:chr?)?([^:]+):([0-9]+)-([0-9]+)", region.strip())
        if not m:
            raise ValueError("a region looks like chr1:100-200")
        region = (m[1], int(m[2]), int(m[3]))
    name, start, end = region
    name = {"23": "X", "24": "Y"}.get(n := re.sub("(?i)^chr", "", str(name)).strip().upper(), n)
    return name, int(start), int(end)


@dataclass
class Store:
    spark: SparkSession
    path: str
    manifest: dict

    @property
    def profile(self) -> str:
        return self.manifest["profile"]

    def table(self) -> DataFrame:
        """All stored columns; chromosome is a partition, kept as text."""
        return self.spark.read.schema(self.manifest["schema"]).parquet(f"{self.path}/values")

    def read(self, region: str | tuple | None = None, variants: Iterable | DataFrame | None = None, columns: list[str] | None = None, ordered: bool = True, use_cache: bool = False) -> DataFrame:
        """Rows that meet all of region and variants (keys as text, row ids as integers, or a DataFrame of either).

        Region and keys reach the scan as partition and column filters; only asked-for columns are decoded.
        """
        wanted = list(dict.fromkeys(columns or DEFAULT_COLUMNS))
        table = self.spark.read.schema(self.manifest["cache_schema"]).parquet(f"{self.path}.q8/values") if use_cache else self.table()
        extras = self.manifest.get("extras", [])
        unknown = [c for c in wanted if c not in COLUMNS and c not in extras]
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        if region is not None:
            name, start, end = parse_region(region)
            table = table.where((F.col("chromosome") == name) & F.col("base_pair_location").between(start, end))
        if variants is not None:
            table = self._among(table, variants)
        profile = "q8" if use_cache else self.profile
        if profile == "exact":
            out = table.withColumn("beta", F.col("z") * F.col("standard_error")).withColumn("p_value", codec.two_sided_p("z"))
        else:
            out = codec.decode(table, PROFILES[profile])
        reference, alternate = identity.decode_alleles(F.col("substitution"))
        out = out.withColumns({"reference_allele": reference, "alternate_allele": alternate, "effect_allele": alternate, "other_allele": reference})
        out = out.withColumn("variant_id", identity.variant_key(F.col("chromosome"), F.col("base_pair_location"), F.col("reference_allele"), F.col("alternate_allele")))
        if ordered:
            out = out.orderBy("row_id")
        return out.select(*wanted)

    def _among(self, table: DataFrame, variants: Iterable | DataFrame) -> DataFrame:
        if isinstance(variants, DataFrame):
            if "row_id" in variants.columns:
                return table.join(select.sized(variants.select("row_id").distinct()), "row_id", "left_semi")
            return table.join(select.sized(select.panel_keys(variants, self.manifest["build"])), "variant_code", "left_semi")
        given = list(variants)
        if given and all(isinstance(x, int) and not isinstance(x, bool) for x in given):
            if min(given) < 0 or max(given) >= self.manifest["n_rows"]:
                raise ValueError("row ids have to lie between 0 and the count of rows less one")
            return table.where(F.col("row_id").isin(sorted(set(given)))) if len(given) <= 1000 else table.join(select.sized(self.spark.createDataFrame([(x,) for x in set(given)], "row_id long")), "row_id", "left_semi")
        keys = sorted({re.sub("(?i)^chr", "", str(x).strip()).upper() for x in given})
        bad = [k for k in keys if not re.fullmatch(r"(?:[1-9]|1[0-9]|2[0-2]|X|Y):[0-9]+:[ACGT]:[ACGT]", k)]
        if bad:
            raise ValueError(f"not canonical variant keys: {', '.join(bad[:5])}")
        starts, codes, names = builds.offsets(self.manifest["build"]), [], set()
        for k in keys:
            name, at, ref, alt = k.split(":")
            codes.append((starts[name] + int(at) - 1) * 16 + 4 * identity.BASES.index(ref) + identity.BASES.index(alt))
            names.add(name)
        table = table.where(F.col("chromosome").isin(sorted(names)))
        if len(codes) <= 1000:
            return table.where(F.col("variant_code").isin(codes))
        low, high = min(codes), max(codes)
        return table.where(F.col("variant_code").between(low, high)).join(select.sized(self.spark.createDataFrame([(c,) for c in codes], "variant_code long")), "variant_code", "left_semi")

    def pvalue_flag(self) -> DataFrame:
        """Row ids of rows whose p-value before encoding was at most the store's threshold."""
        if self.manifest.get("pvalue_flag_threshold") is None:
            raise StoreError("the store has no p-value flag")
        return self.table().where("pvalue_flag").select("row_id")

    def fetch_flagged(self, columns: list[str] | None = None) -> DataFrame:
        """The flagged rows' columns in one scan, without a round trip of ids."""
        wanted = columns or DEFAULT_COLUMNS
        return self.read(columns=[*wanted, "pvalue_flag"], ordered=False).where("pvalue_flag").select(*wanted)

    def validate(self, full: bool = True) -> dict:
        """Row ids contiguous and unique, order kept, codes in their domains; with `full` also the digests of all files."""
        if full:
            files.check_payload(self.spark, self.path, self.manifest)
        table = self.table()
        if full:
            total = self._followed(table)
        else:
            total = table.agg(F.count("*").alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count_distinct("row_id").alias("ids"), F.count_distinct("variant_code").alias("codes")).first()
        n = total.n
        if n != self.manifest["n_rows"] or total.ids != n or total.codes != n or (n and (total.low, total.high) != (0, n - 1)):
            raise StoreError("rows are missing or repeat")
        # each block lies behind the one before, which is there
        spans = table.groupBy("block_id").agg(F.min("variant_code").alias("a"), F.max("variant_code").alias("z"))
        before = spans.select((F.col("block_id") + 1).alias("block_id"), F.col("z").alias("end"))
        if spans.where("block_id <> 0").join(before, "block_id", "left").where("end is null or end >= a").limit(1).count():
            raise StoreError("blocks overlap")
        if self.profile != "exact" and codec.bad_codes(table, PROFILES[self.profile]).limit(1).count():
            raise StoreError("codes lie out of their domains")
        blocks = spans.agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("z").alias("z")).first()
        return {"valid": True, "n_rows": n, "first_row": total.low, "last_row": total.high, "n_blocks": blocks.n, "first_variant": blocks.a, "last_variant": blocks.z}

    @staticmethod
    def _followed(table: DataFrame):
        """Counts of rows, of those that follow the row before in their block by one (ids), and by a greater code (codes).

        Where all do, and blocks don't overlap, neither ids nor codes repeat; a task sorts blocks of VALUE_BLOCK rows and keeps no set of all values.
        """
        w = Window.partitionBy("block_id").orderBy("row_id")
        rows = table.select("block_id", "row_id", "variant_code").withColumns({"_row": F.lag("row_id").over(w), "_code": F.lag("variant_code").over(w)})
        own = F.floor(F.col("row_id") / VALUE_BLOCK) == F.col("block_id")
        follows, greater = own & (F.coalesce("_row", F.col("row_id") - 1) == F.col("row_id") - 1), F.coalesce("_code", F.col("variant_code") - 1) < F.col("variant_code")
        n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
        return rows.agg(F.count("*").alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), n(follows).alias("ids"), n(greater).alias("codes")).first()

    def regions(self) -> DataFrame:
        """The windows that selection kept rows by: chromosome, start, end, seed_snps."""
        if not self.manifest["selection"].get("regions"):
            raise StoreError("the store wasn't selected by regions")
        return self.spark.read.parquet(f"{self.path}/regions")

    def build_cache(self) -> DataFrame:
        """A second table at eight bits each for z, frequency and SE, beside the store."""
        decoded = self.read(columns=["chromosome", "base_pair_location", "global_position", "substitution", "variant_code", "row_id", "z", "standard_error", "effect_allele_frequency", "pvalue_flag"], ordered=False)
        out = codec.encode(decoded, Q8).select("chromosome", *CODES)
        staged = files.staging(self.spark, f"{self.path}.q8", True)
        _write(out, f"{staged}/values")
        files.commit(self.spark, staged, f"{self.path}.q8")
        self.manifest["cache_schema"] = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
        return self.read(use_cache=True)


def _write(df: DataFrame, path: str) -> None:
    """Rows that lie by ranges of the genome, as numbered ones do, sorted by chromosome where they lie: scans prune partitions and pages."""
    df.sortWithinPartitions("chromosome", "variant_code").write.option("compression", "zstd").partitionBy("chromosome").parquet(path)


def write_store(df: DataFrame, path: str, *, build: str = "GRCh38", profile: str = "z9_eaf8_se6", flag_threshold: float | None = 5e-8, extras: tuple[str, ...] = (), selection: str = "full", panel: DataFrame | None = None, select_threshold: float = 1e-5, padding: int = 10_000, overwrite: bool = False, meta: dict | None = None, observer: Observer | None = None) -> Store:
    """Canonical rows with z, standard_error, effect_allele_frequency and p_value into a new store."""
    spark, began = df.sparkSession, time.time()
    if profile != "exact" and profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    staged = files.staging(spark, path, overwrite)
    watch = observer or Observer()
    with watch.phase("select_and_number") as found:
        chosen, regions = select.select_variants(df, selection, panel, select_threshold, padding, build)
        resolved = select.resolve_p(chosen)
        flag = codec.pvalue_flag(flag_threshold) if flag_threshold is not None else F.lit(None).cast("boolean")
        ready = resolved.withColumn("pvalue_flag", flag)
        keep = ["chromosome", "base_pair_location", "global_position", "substitution", "variant_code", "z", "standard_error", "effect_allele_frequency", "pvalue_flag", *extras]
        numbered = with_row_id(ready.select(*keep), ["variant_code"], copies="_copy")
        if numbered.where("_copy > 1").limit(1).count():
            raise StoreError("a variant occurs more than once")
        numbered = numbered.drop("_copy")
        found["rows"] = n = numbered.count()
    if not n:
        raise StoreError("no rows are left to store")
    with watch.phase("encode_and_write") as found:
        if profile == "exact":
            out = codec.with_blocks(numbered).select("chromosome", *EXACT, *extras)
        else:
            out = codec.encode(numbered, PROFILES[profile]).select("chromosome", *CODES, *extras)
        _write(out, f"{staged}/values")
        found["rows"] = n
    if regions is not None:
        with watch.phase("regions"):
            regions.write.parquet(f"{staged}/regions")
    manifest = {
        "format": FORMAT, "version": VERSION, "build": builds.normalize_build(build), "profile": profile, "n_rows": n, "extras": list(extras),
        "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema), "pvalue_flag_threshold": flag_threshold,
        "selection": {"mode": selection, "threshold": select_threshold, "padding": padding, "regions": regions is not None}, "tolerances": codec.TOLERANCES, **(meta or {}),
        "created_utc": datetime.now(UTC).isoformat(), "timings": {**watch.summary(), "write_s": round(time.time() - began, 3)},
    }
    manifest = files.seal(spark, staged, manifest)
    files.commit(spark, staged, path)
    return Store(spark, path, manifest)


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, files.open_manifest(spark, path, FORMAT, VERSION))


def read_batch(stores: dict[str, Store], variants: Iterable | DataFrame | None = None, region: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """One table over several stores, with the study's name; each store is pruned by itself."""
    if not stores:
        raise ValueError("no stores given")
    out = None
    for name, store in stores.items():
        part = store.read(region, variants, columns, ordered=False).select(F.lit(name).alias("study"), "*")
        out = part if out is None else out.unionByName(part)
    return out
