"""From source headers and text to the canonical columns: aliases, numbers, and the statistics that follow from others."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import normalize_chromosome
from ..functions.stats import failed_number, finite, is_missing, parse_number, se_from_p

REQUIRED = ["chromosome", "base_pair_location", "reference_allele", "alternate_allele", "effect_allele", "other_allele", "beta", "standard_error"]
#: Names that sources use for each column, most preferred first; compared through alias_key.
ALIASES = {
    "chromosome": ["chromosome", "chr", "#chrom", "CHROM"],
    "base_pair_location": ["base_pair_location", "position", "pos", "bp", "GENPOS"],
    "reference_allele": ["reference_allele", "reference", "ref"],
    "alternate_allele": ["alternate_allele", "alternate", "alt"],
    "effect_allele": ["effect_allele", "ea", "a1", "ALLELE1", "alleleB"],
    "other_allele": ["other_allele", "oa", "NEA", "a2", "ALLELE0", "alleleA"],
    "beta": ["beta", "effect", "effect_size", "estimate", "ES", "LOGOR", "LOG_OR", "log_odds", "BETA_LINREG", "BETA_LMM"],
    "z": ["z", "zscore", "Z_SCORE", "z_stat", "ZSTAT", "zstatistic", "Z_STATISTIC", "Z_BOLT_LMM"],
    "odds_ratio": ["odds_ratio", "OR", "ODDSRATIO"],
    "standard_error": ["standard_error", "SE", "sebeta", "stderr", "std_err"],
    "effect_allele_frequency": ["effect_allele_frequency", "eaf", "af", "effect_af", "A1FREQ", "ALT_FREQ", "ALT_AF", "EAF_ALT"],
    "p_value": ["p_value", "p", "pval", "pvalue", "P_BOLT_LMM"],
    "minus_log10_p": ["minus_log10_p", "LP", "neglog10p", "-LOG10P", "LOG10P"],
    "variant_id": ["variant_id", "SNPID", "SNP_ID", "SNP", "variant", "ID"],
    "rsid": ["rsid", "rsids", "rs_id", "dbsnp"],
    "sample_size": ["sample_size", "N", "SS", "N_TOTAL", "TOTALSAMPLESIZE", "N_SUMMARY"],
    "info": ["INFO_SCORE", "IMPINFO", "INFO", "R2", "RSQ", "INFO_SCORE_IMP"],
    "expected_count": ["expected_count", "B", "expected_nonref_count", "nonref_count"],
}
NUMBERS = ["base_pair_location", "beta", "standard_error", "z", "odds_ratio", "effect_allele_frequency", "p_value", "minus_log10_p", "sample_size", "info"]
#: Types whose values need no text to become doubles: the same double comes back, and NaN is missing.
EXACT_NUMBERS = ("tinyint", "smallint", "int", "bigint", "double")
CORE = [*REQUIRED, "z", "effect_allele_frequency", "odds_ratio"]


class ResolutionError(ValueError):
    """Columns or statistics of the input contradict each other."""


def alias_key(name: str) -> str:
    return re.sub("[^a-z0-9#]", "", name.lower())


def clean_names(df: DataFrame) -> DataFrame:
    """Without byte order mark and blanks; unnamed columns are numbered."""
    names = [c.lstrip("﻿").strip() or f"unnamed_{i + 1}" for i, c in enumerate(df.columns)]
    return df.toDF(*names)


def alias_hits(columns: list[str]) -> dict[str, list[str]]:
    """Canonical name -> source columns, most preferred first."""
    out: dict[str, list[str]] = {}
    for target, names in ALIASES.items():
        keys = list(dict.fromkeys(map(alias_key, names)))
        if found := [c for k in keys for c in columns if alias_key(c) == k]:
            out[target] = found
    return out


def project(df: DataFrame, core_only: bool = False, keep_p: bool = True) -> DataFrame:
    """Recognised columns alone, so that the source isn't parsed further; the first column if none is.

    An ordinal of the source stays: a new one would follow the order in which files are read, and with it the first copy of a variant.
    """
    wanted = [*CORE, *(["p_value", "minus_log10_p"] if keep_p else [])] if core_only else list(ALIASES)
    hits = alias_hits(df.columns)
    picked = {c for t in wanted for c in hits.get(t, [])}
    picked |= {"ordinal"} if [t for c, t in df.dtypes if c == "ordinal"] in (["bigint"], ["int"]) and picked else set()
    return df.select(*([f"`{c}`" for c in df.columns if c in picked] or [f"`{df.columns[0]}`"]))


def as_number(c: Column) -> Column:
    """What parse_number makes of a column of EXACT_NUMBERS."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def _differs(a: Column, b: Column) -> Column:
    """Neither equal as text, nor both missing, nor within 1e-12 of each other as numbers."""
    x, y = parse_number(a), parse_number(b)
    close = F.coalesce(F.abs(x - y) <= 1e-12 * F.greatest(F.abs(x), F.abs(y), F.lit(1e-300)), F.lit(False))
    same = F.coalesce(a.cast("string") == b.cast("string"), F.lit(False)) | (is_missing(a.cast("string")) & is_missing(b.cast("string")))
    return ~(same | close)


def conflict_counts(df: DataFrame) -> DataFrame:
    """(preferred, other, n): rows in which two source columns of one meaning differ; one pass."""
    pairs = [(found[0], other) for found in alias_hits(df.columns).values() for other in found[1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "preferred string, other string, n long")
    counts = [F.sum(F.coalesce(_differs(F.col(f"`{a}`"), F.col(f"`{b}`")), F.lit(False)).cast("long")) for a, b in pairs]
    rows = F.array(*(F.struct(F.lit(a).alias("preferred"), F.lit(b).alias("other"), F.coalesce(n, F.lit(0)).alias("n")) for (a, b), n in zip(pairs, counts, strict=True)))
    return df.agg(rows.alias("r")).select(F.inline("r"))


@dataclass
class Resolved:
    data: DataFrame
    source_columns: list[str]
    routes: dict[str, str] = field(default_factory=dict)


def _tolerance(a: Column, b: Column) -> Column:
    return 1e-6 + 0.01 * F.greatest(F.abs(a), F.abs(b))


def resolve(df: DataFrame, policy: str = "report", allow_p_to_se: bool = False, check: bool = True) -> Resolved:
    """Canonical columns with an ordinal and parse_failed, the names of columns whose text wasn't a number.

    Contradictions (two aliases that differ, beta against OR, SE against p, z against beta/SE) always raise; all are
    counted in one pass. With policy `error` so do texts that aren't numbers, ratios out of range, and missing columns.
    """
    df = clean_names(df)
    hits, conflicts = alias_hits(df.columns), {}
    out = df if "ordinal" in df.columns else df.withColumn("ordinal", F.monotonically_increasing_id())
    for target, found in hits.items():
        for other in found[1:]:
            conflicts[f"columns {found[0]} and {other} differ"] = _differs(F.col(f"`{found[0]}`"), F.col(f"`{other}`"))
    drop = {c for found in hits.values() for c in found}
    rest = [F.col(f"`{c}`") for c in out.columns if c not in drop and c not in hits]
    named = [F.col(f"`{found[0]}`").alias(target) for target, found in hits.items()]
    conflict_cols = [c.alias(f"_c{i}") for i, c in enumerate(conflicts.values())]
    out = out.select(*rest, *named, *conflict_cols)
    tests: dict[str, Column] = {name: F.col(f"_c{i}") for i, name in enumerate(conflicts)}
    has = set(out.columns)
    numbers = [c for c in NUMBERS if c in has]
    exact = {c for c, t in out.dtypes if t in EXACT_NUMBERS}
    texts = [c for c in numbers if c not in exact]
    failed = F.array_except(F.array(*(F.when(failed_number(F.col(c)), F.lit(c)) for c in texts)), F.array(F.lit(None).cast("string"))) if texts else F.array().cast("array<string>")
    out = out.withColumn("parse_failed", failed).withColumns({c: as_number(F.col(c)) if c in exact else parse_number(F.col(c)) for c in numbers})
    if "base_pair_location" in has:
        at = F.col("base_pair_location")
        whole = finite(at) & (at == F.floor(at)) & (F.abs(at) <= 2147483647)
        out = out.withColumn("parse_failed", F.when(at.isNotNull() & ~F.coalesce(whole, F.lit(False)), F.array_append("parse_failed", F.lit("base_pair_location"))).otherwise(F.col("parse_failed"))).withColumn("base_pair_location", F.when(whole, at).cast("long"))
    for name in ["beta", "standard_error", "z", "effect_allele_frequency", "p_value"]:
        if name not in has:
            out = out.withColumn(name, F.lit(None).cast("double"))
    beta, se, p = F.col("beta"), F.col("standard_error"), F.col("p_value")
    routes = {"beta": "supplied" if "beta" in has else "missing", "z": "supplied" if "z" in has else "derived", "p_value": "supplied" if "p_value" in has else "missing", "standard_error": "supplied" if "standard_error" in has else "missing"}
    if "odds_ratio" in has:
        ratio = F.col("odds_ratio")
        usable = finite(ratio) & (ratio > 0)
        log_or = F.when(usable, F.ln(ratio))
        if policy == "error":
            tests["odds_ratio has to be finite and positive"] = ratio.isNotNull() & ~usable
        out = out.withColumn("_or", F.coalesce(finite(beta) & usable & (F.abs(beta - log_or) > _tolerance(beta, log_or)), F.lit(False)))
        tests["beta and odds_ratio are inconsistent"] = F.col("_or")
        out = out.withColumn("beta", F.when(beta.isNull(), log_or).otherwise(beta))
        routes["beta"] = "supplied, else log of odds_ratio" if "beta" in has else "log of odds_ratio"
    if "minus_log10_p" in has:
        lp = F.col("minus_log10_p")
        out = out.withColumn("p_value", F.when(p.isNull() & finite(lp), F.pow(F.lit(10.0), -lp)).otherwise(p))
        routes["p_value"] = "supplied, else from minus_log10_p"
    out = out.withColumn("z", F.when(F.col("z").isNull() & finite(beta) & finite(se) & (se > 0), beta / se).otherwise(F.col("z")))
    if allow_p_to_se:
        derived = se_from_p("beta", "p_value")
        given = finite(se) & (se > 0)
        out = out.withColumn("_se", derived)
        tests["standard_error conflicts with the value that p implies"] = F.coalesce(given & F.col("_se").isNotNull() & (F.abs(se - F.col("_se")) > _tolerance(se, F.col("_se"))), F.lit(False))
        out = out.withColumn("_given", F.coalesce(given, F.lit(False))).withColumn("standard_error", F.when(F.col("_given"), se).otherwise(F.coalesce("_se", "standard_error")))
        out = out.withColumn("z", F.when(F.col("z").isNull() & finite(beta) & finite(F.col("standard_error")) & (F.col("standard_error") > 0), beta / F.col("standard_error")).otherwise(F.col("z")))
        routes["standard_error"] = "supplied, else from beta and p"
    z = F.col("z")
    tests["z is inconsistent with beta and standard_error"] = F.coalesce(finite(z) & finite(beta) & finite(se) & (se > 0) & (F.abs(beta - z * se) > _tolerance(beta, z * se)), F.lit(False))
    if policy == "error":
        tests["a number can't be read"] = F.size("parse_failed") > 0
        missing = [c for c in REQUIRED if c not in out.columns or (c in ("beta", "standard_error") and routes[c] == "missing")]
        if missing:
            raise ResolutionError(f"required columns are missing: {', '.join(missing)}")
    if check and tests:
        found = out.agg(*(F.max(F.coalesce(t, F.lit(False)).cast("int")).alias(f"t{i}") for i, t in enumerate(tests.values()))).first()
        bad = [name for i, name in enumerate(tests) if found[i]]
        if bad:
            rows = out.where(tests[bad[0]]).select("ordinal").orderBy("ordinal").limit(5).collect()
            raise ResolutionError(f"{'; '.join(bad)} (first at row(s) {', '.join(str(r.ordinal + 1) for r in rows)})")
    out = with_variant_ids(out.drop(*[c for c in out.columns if c.startswith("_")]))
    return Resolved(out, df.columns, routes)


def with_variant_ids(df: DataFrame) -> DataFrame:
    """Fills variant_id as chromosome_position_other_effect, and rsid from ids that look like one."""
    made = F.concat(normalize_chromosome(F.col("chromosome")), F.lit("_"), F.col("base_pair_location").cast("string"), F.lit("_"), F.upper("other_allele"), F.lit("_"), F.upper("effect_allele")) if {"chromosome", "base_pair_location", "other_allele", "effect_allele"} <= set(df.columns) else F.lit(None).cast("string")
    given = F.col("variant_id") if "variant_id" in df.columns else F.lit(None).cast("string")
    out = df.withColumn("variant_id", F.coalesce(F.when(~is_missing(given), given), made))
    rs = F.when(F.col("variant_id").rlike("^(?i)rs"), F.col("variant_id"))
    return out.withColumn("rsid", F.coalesce(F.when(~is_missing(F.col("rsid")), F.col("rsid")), rs) if "rsid" in df.columns else rs)


def trusted(df: DataFrame) -> DataFrame:
    """Canonical names taken as they are, numbers parsed, z derived; no aliases, no ratios, no checks."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ResolutionError(f"canonical columns are missing: {', '.join(missing)}")
    out = df if "ordinal" in df.columns else df.withColumn("ordinal", F.monotonically_increasing_id())
    out = out.withColumns({c: parse_number(F.col(c)) for c in NUMBERS if c in out.columns})
    for name in ["z", "effect_allele_frequency", "p_value"]:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    beta, se = F.col("beta"), F.col("standard_error")
    return out.withColumn("z", F.when(F.col("z").isNull() & finite(beta) & finite(se) & (se > 0), beta / se).otherwise(F.col("z")))
