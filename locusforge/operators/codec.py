"""Semantic quantisation of z, effect allele frequency and standard error, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import tuned
from ..functions.stats import finite, two_sided_p
from .rowid import with_blocks

LOG2 = lambda x: F.log2(x)


@dataclass(frozen=True)
class Profile:
    """Fixed values of a codec: bins of z over +-z_limit, steps of the frequency grid, bins of the residual over +-1."""

    name: str = "z9_eaf8_se6"
    z_bins: int = 510
    z_limit: float = 3.5
    z_upper_inclusive: bool = False
    eaf_steps: int = 255
    eaf_missing: int = 128
    se_bins: int = 62

    @property
    def z_step(self) -> float:
        return 2 * self.z_limit / self.z_bins


NATIVE = Profile()
LEGACY = Profile("legacy_clamp", z_upper_inclusive=True, eaf_steps=254, eaf_missing=255)
TOLERANCES = {"z_abs_max": 7 / (2 * 510), "se_rel_max": 2 ** (4 / 62) - 1, "eaf_abs_max": 0.004}


def z_code(z: Column, p: Profile = NATIVE) -> Column:
    """Bin; z_bins if z isn't finite, z_bins + 1 if it is out of range."""
    top = (z <= p.z_limit) if p.z_upper_inclusive else (z < p.z_limit)
    code = F.floor((z + p.z_limit) / F.lit(p.z_step))
    if p.z_upper_inclusive:
        code = F.least(code, F.lit(p.z_bins - 1))
    return F.when(~finite(z), p.z_bins).when((z >= -p.z_limit) & top, code).otherwise(p.z_bins + 1).cast("smallint")


def decode_z(code: Column, p: Profile = NATIVE) -> Column:
    return F.when(code < p.z_bins, F.lit(-p.z_limit) + (code + 0.5) * F.lit(p.z_step))


def eaf_valid(eaf: Column) -> Column:
    return F.coalesce(finite(eaf) & eaf.between(0, 1), F.lit(False))


def eaf_code(eaf: Column, p: Profile = NATIVE) -> Column:
    """Arcsine grid; the missing code where the frequency isn't in [0, 1]."""
    safe = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), eaf))
    return F.when(eaf_valid(eaf), F.rint(F.lit(p.eaf_steps * 2 / math.pi) * F.asin(F.sqrt(safe)))).otherwise(p.eaf_missing).cast("smallint")


def decode_eaf(code: Column, p: Profile = NATIVE) -> Column:
    """The grid's value; of the legacy missing code 0.5, the predictor's fallback."""
    value = F.pow(F.sin(code * F.lit(math.pi / (2 * p.eaf_steps))), 2)
    return value if p.eaf_missing <= p.eaf_steps else F.when(code == p.eaf_missing, F.lit(0.5)).otherwise(value)


def half_log_variance(frequency: Column) -> Column:
    safe = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), frequency))
    return 0.5 * LOG2(2 * safe * (1 - safe))


def se_valid(se: Column) -> Column:
    return F.coalesce(finite(se) & (se > 0), F.lit(False))


def with_residual(df: DataFrame, p: Profile = NATIVE) -> DataFrame:
    """Adds codes of z and frequency, and the residual of log2(SE) that the decoded frequency leaves."""
    se, eaf = F.col("standard_error").cast("double"), F.col("effect_allele_frequency").cast("double")
    coded = df.withColumn("z_code", z_code(F.col("z").cast("double"), p)).withColumn("eaf_code", eaf_code(eaf, p))
    return coded.withColumn("se_residual", F.when(se_valid(se), LOG2(se) + half_log_variance(decode_eaf(F.col("eaf_code"), p))))


def block_centres(df: DataFrame) -> DataFrame:
    """The median residual of each block, 0 for a block without any. A block has VALUE_BLOCK rows at most."""
    return df.groupBy("block_id").agg(F.coalesce(F.median("se_residual"), F.lit(0.0)).alias("se_centre"))


def encode(df: DataFrame, p: Profile = NATIVE, row_id: str = "row_id") -> DataFrame:
    """Adds block_id, codes, se_centre, and exceptions as columns that are null for all but few rows.

    Centres are one row for VALUE_BLOCK rows, and so are broadcast; a join that Spark plans by the size of the rows would move all rows first.
    """
    coded = with_residual(with_blocks(tuned(df), row_id), p)
    joined = coded.join(F.broadcast(block_centres(coded)), "block_id")
    delta = F.col("se_residual") - F.col("se_centre")
    if p.name == "legacy_clamp":
        code = F.least(F.lit(p.se_bins - 1), F.greatest(F.lit(0), F.floor((delta + 1) / 2 * p.se_bins - 0.5)))
        se = F.when(F.col("se_residual").isNull(), p.se_bins).otherwise(code)
    else:
        se = F.when(F.col("se_residual").isNull(), p.se_bins).when((delta >= -1) & (delta < 1), F.floor((delta + 1) / F.lit(2 / p.se_bins))).otherwise(p.se_bins + 1)
    z, eaf = F.col("z").cast("double"), F.col("effect_allele_frequency").cast("double")
    coded = joined.withColumn("se_code", se.cast("tinyint" if p.se_bins < 126 else "smallint"))
    flags = F.when(F.col("z_code") == p.z_bins + 1, 1).otherwise(0) + F.when(F.col("se_code") == p.se_bins + 1, 2).otherwise(0) + F.when(~eaf_valid(eaf), 4).otherwise(0)
    kind = "double" if p.name == "legacy_clamp" else "float"
    hit = lambda value: F.when(F.col("exc_flags").isNotNull(), value.cast(kind))
    return (
        coded.withColumn("exc_flags", F.when(flags > 0, flags).cast("tinyint"))
        .withColumn("exc_z", hit(z))
        .withColumn("exc_log2se", hit(F.when(se_valid(F.col("standard_error")), LOG2(F.col("standard_error"))).otherwise(0.0)))
        .withColumn("exc_eaf", hit(eaf))
        .drop("se_residual")
    )


def _flag(bit: int) -> Column:
    return F.coalesce(F.col("exc_flags").bitwiseAND(bit) != 0, F.lit(False))


def decoded(p: Profile = NATIVE) -> dict[str, Column]:
    """z, effect_allele_frequency, standard_error from codes. SE is predicted from the frequency before its exception."""
    grid = decode_eaf(F.col("eaf_code"), p)
    shift = 0.0 if p.name != "legacy_clamp" else 0.5
    delta = F.lit(-1.0) + (F.col("se_code") + 0.5 + shift) * F.lit(2 / p.se_bins)
    se = F.when(F.col("se_code") < p.se_bins, F.pow(F.lit(2.0), delta + F.col("se_centre") - half_log_variance(grid)))
    return {
        "z": F.when(_flag(1), F.col("exc_z").cast("double")).otherwise(decode_z(F.col("z_code"), p)),
        "effect_allele_frequency": F.when(_flag(4), F.col("exc_eaf").cast("double")).otherwise(grid),
        "standard_error": F.when(_flag(2), F.pow(F.lit(2.0), F.col("exc_log2se").cast("double"))).otherwise(se),
    }


def decode(df: DataFrame, p: Profile = NATIVE, derived: bool = True) -> DataFrame:
    """Codes to values; with beta = z * SE and the two-sided p of z. Columns that nobody asks for are pruned."""
    out = tuned(df).withColumns(decoded(p))
    if derived:
        out = out.withColumn("beta", F.col("z") * F.col("standard_error")).withColumn("p_value", two_sided_p("z"))
    return out


def exception_counts(df: DataFrame) -> DataFrame:
    """How many rows have each exception, and their densities."""
    n = lambda bit: F.sum(_flag(bit).cast("long"))
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.col("exc_flags").isNotNull().cast("long")).alias("exceptions"), n(1).alias("z_exceptions"), n(2).alias("se_exceptions"), n(4).alias("eaf_exceptions")).withColumn("density", F.when(F.col("n_rows") > 0, F.col("exceptions") / F.col("n_rows")))


def bad_codes(df: DataFrame, p: Profile = NATIVE) -> DataFrame:
    """Rows whose codes are out of their domains."""
    good = F.col("z_code").between(0, p.z_bins + 1) & F.col("eaf_code").between(0, 255) & F.col("se_code").between(0, p.se_bins + 1) & F.col("substitution").between(1, 14) & F.coalesce(F.col("exc_flags").between(1, 7), F.lit(True))
    return df.where(~F.coalesce(good, F.lit(False)))


def pvalue_flag(threshold: float, name: str = "p_resolved") -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError("the flag's threshold has to lie in [0, 1]")
    return F.coalesce(finite(F.col(name)) & (F.col(name) <= threshold), F.lit(False))


def residual_limits(df: DataFrame) -> DataFrame:
    return df.where(se_valid(F.col("standard_error"))).agg(F.percentile(F.log2("standard_error"), F.array(F.lit(0.005), F.lit(0.995))).alias("limits"))
