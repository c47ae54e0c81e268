"""The public functions, one for each thing a user of summary statistics does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions.builds import normalize_build
from .functions.observe import Observer
from .operators import qc, resolve
from .sources import delimited, panel, store

open_store, read_batch = store.open_store, store.read_batch
open_panel, write_panel = panel.open_panel, panel.write_panel


@dataclass
class Imported:
    data: DataFrame
    source_columns: list[str]
    routes: dict[str, str]
    report: qc.QcReport | None = None


def import_sumstats(spark: SparkSession, source: str | DataFrame, *, strict: bool = False, row_policy: str = "report", build: str = "GRCh38", allow_p_to_se: bool = False, check: bool = False) -> Imported:
    """Read and resolve; with `check` also QC, which drops or raises by policy. Unknown columns stay."""
    policy = "error" if strict else row_policy
    found = resolve.resolve(delimited.read_input(spark, source), policy, allow_p_to_se)
    if not check:
        return Imported(found.data, found.source_columns, found.routes)
    kept, report = qc.apply(found.data, policy, build=build)
    return Imported(kept, found.source_columns, found.routes, report)


def preflight(spark: SparkSession, source: str | DataFrame, **options) -> Imported:
    """Import with full QC: accepted rows and the report."""
    return import_sumstats(spark, source, check=True, **options)


def compress(spark: SparkSession, source: str | DataFrame, path: str, *, input_build: str = "GRCh38", build: str = "GRCh38", qc_mode: str = "compact", strict: bool = False, row_policy: str | None = None, allow_p_to_se: bool = False, environ: dict[str, str] | None = None, **options) -> store.Store:
    """Import, check, and write a store. qc_mode `none` trusts canonical columns and drops only what has no identity.

    panel: a DataFrame, a path, or a name (core, hm3, common, tag; name@sha256:<hex> pins its digest); environ has the paths of names.
    """
    if normalize_build(input_build) != normalize_build(build):
        raise ValueError("input and store have to be of one build; lift over first")
    if qc_mode not in ("compact", "none"):
        raise ValueError("qc_mode has to be compact or none")
    if qc_mode == "none" and (strict or row_policy == "error"):
        raise ValueError("qc_mode none can't be strict")
    if strict and row_policy == "report":
        raise ValueError("strict and row_policy disagree")
    watch = options.setdefault("observer", Observer())
    frame = delimited.read_input(spark, source)
    lacking = {"reference_allele", "alternate_allele", "effect_allele", "other_allele"} - set(resolve.alias_hits(frame.columns))
    if lacking:
        raise resolve.ResolutionError(f"explicit REF, ALT and effect alleles are needed; missing: {', '.join(sorted(lacking))}")
    if qc_mode == "none":
        rows, meta = qc.filter_identity_safe(resolve.trusted(frame), build), {"qc": {"mode": "none"}}
    else:
        policy = row_policy or ("error" if strict else "report")
        found = resolve.resolve(resolve.project(frame) if "extras" not in options else frame, policy, allow_p_to_se)
        with watch.phase("quality_control") as phase:
            rows, report = qc.apply(found.data, policy, build=build)
            phase["rows"] = report.input_rows
        meta = {"qc": {"mode": "compact", **report.__dict__}, "routes": found.routes}
    if qc_mode == "compact":
        qc.assert_values(rows)
    meta |= {"source": {"input": source if isinstance(source, str) else "DataFrame", "columns": frame.columns, "build": normalize_build(input_build)}, "tasks": spark.sparkContext.defaultParallelism}
    if isinstance(options.get("panel"), str):
        options["panel"], meta["panel"] = panel.named(spark, options["panel"], build, environ)
    return store.write_store(qc.canonicalize(rows, build), path, build=build, meta=meta, **options)


def read(source: store.Store, **options) -> DataFrame:
    return source.read(**options)


decompress = read


def read_pvalue_flag(source: store.Store) -> DataFrame:
    return source.pvalue_flag()


def validate(source: store.Store | panel.Panel, **options) -> dict:
    return source.validate(**options)


def build_cache(source: store.Store) -> DataFrame:
    return source.build_cache()


def read_panel(source: panel.Panel, **options) -> DataFrame:
    return source.read(**options)


def variant_key(chromosome: str, position: int, reference: str, alternate: str, build: str = "GRCh38") -> str:
    """chromosome:position:REF:ALT of one variant, checked against the assembly."""
    from .functions import builds

    name = {"23": "X", "24": "Y"}.get(n := str(chromosome).strip().upper().removeprefix("CHR"), n)
    sizes, ref, alt = builds.lengths(build), reference.upper(), alternate.upper()
    if name not in sizes or not 1 <= position <= sizes[name]:
        raise ValueError("not a place of the assembly")
    if ref == alt or not {ref, alt} <= set("ACGT") or len(ref + alt) != 2:
        raise ValueError("REF and ALT have to be two different bases")
    return f"{name}:{int(position)}:{ref}:{alt}"
