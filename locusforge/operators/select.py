"""Selection of variants: panels by identity, windows around strong associations, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import builds, identity, stats
from ..functions.session import tuned

#: Rows of a key or region table that may be broadcast, by count; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
INT_MAX = 2_147_483_647


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if a count shows no more than `most` rows; a count beyond stops as soon as it is reached."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def check_arguments(threshold: float, padding: int) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("the p-value threshold has to lie in (0, 1]")
    if padding < 0 or padding != int(padding):
        raise ValueError("padding has to be a whole number of bases, 0 or more")


def resolve_p(df: DataFrame) -> DataFrame:
    """Adds p_resolved and p_source: a valid supplied p is authoritative, else two-sided from z, else unresolved."""
    p = F.col("p_value").cast("double")
    valid = stats.finite(p) & p.between(0, 1)
    if "parse_failed" in df.columns:
        valid = valid & ~F.array_contains("parse_failed", "p_value")
    derived = stats.two_sided_p("z")
    return tuned(df).withColumn("p_resolved", F.when(valid, p).otherwise(derived)).withColumn("p_source", F.when(valid, "supplied").when(stats.finite(F.col("z")), "derived").otherwise("unresolved"))


def p_provenance(df: DataFrame, threshold: float) -> DataFrame:
    """Counters of where p-values come from."""
    resolved = resolve_p(df)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    missing = F.col("p_value").isNull() | F.isnan("p_value")
    return resolved.agg(
        F.count("*").alias("n_rows"),
        n(F.col("p_source") == "supplied").alias("supplied"),
        n(F.col("p_source") == "derived").alias("derived"),
        n(missing).alias("missing"),
        n(~missing & (F.col("p_source") != "supplied")).alias("invalid"),
        n(F.col("p_source") == "unresolved").alias("unresolved"),
        n(F.col("p_resolved") <= threshold).alias("hits"),
    )


def seeds(df: DataFrame, threshold: float) -> DataFrame:
    """Rows with a valid coordinate and p at most the threshold."""
    return resolve_p(df).where((F.col("p_resolved") <= threshold) & identity.is_primary(F.col("chromosome")) & (F.col("base_pair_location") >= 1))


def windows(seed: DataFrame, padding: int) -> DataFrame:
    at = F.col("base_pair_location").cast("bigint")
    return seed.select("chromosome", F.greatest(at - padding, F.lit(1).cast("bigint")).alias("start"), F.least(at + padding, F.lit(INT_MAX).cast("bigint")).alias("end"))


def merge_intervals(df: DataFrame) -> DataFrame:
    """(chromosome, start, end) to disjoint regions with their seed_snps; adjacent ones merge."""
    w = Window.partitionBy("chromosome").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(F.col("start") > F.col("reach") + 1, F.lit(True))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = df.groupBy("chromosome", "start", "end").agg(F.count("*").alias("n"))  # equal windows first, where they lie
    marked = same.withColumn("reach", reach).withColumn("island", island)
    return marked.groupBy("chromosome", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("seed_snps")).drop("island")


def pvalue_regions(df: DataFrame, threshold: float, padding: int) -> DataFrame:
    check_arguments(threshold, padding)
    return merge_intervals(windows(seeds(df, threshold), padding))


BIN = 1 << 20


def binned(regions: DataFrame) -> DataFrame:
    """Each region once for each bin of the genome that it touches."""
    bins = F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))
    return regions.select(F.col("chromosome").alias("r_chromosome"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.explode(bins).alias("r_bin"))


def in_regions(df: DataFrame, regions: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows inside any region: an equi-join on chromosome and bin with the bounds as residual, so that it never nests loops."""
    near = sized(binned(regions))
    at = F.col("base_pair_location").cast("bigint")
    return df.join(near, (F.col("chromosome") == F.col("r_chromosome")) & (F.floor(at / BIN) == F.col("r_bin")) & at.between(F.col("r_start"), F.col("r_end")), how)


def with_region_mask(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds in_region. Regions are disjoint, so that a row meets one at most."""
    return in_regions(df, regions, "left").withColumn("in_region", F.col("r_bin").isNotNull()).drop("r_chromosome", "r_start", "r_end", "r_bin")


def panel_keys(panel: DataFrame, build: str = "GRCh38") -> DataFrame:
    """Distinct codes of a panel that has variant_code, identity columns, or canonical variant_id."""
    if "variant_code" in panel.columns:
        code = F.col("variant_code")
    elif {"chromosome", "base_pair_location", "reference_allele", "alternate_allele"} <= set(panel.columns):
        code = identity.variant_code(identity.normalize_chromosome(F.col("chromosome")), F.col("base_pair_location"), F.upper("reference_allele"), F.upper("alternate_allele"), build)
    else:
        k = identity.parse_key(F.col("variant_id"))
        code = identity.variant_code(k["chromosome"], k["position"], k["reference"], k["alternate"], build)
    return panel.select(code.alias("variant_code")).where("variant_code is not null").distinct()


def in_panel(df: DataFrame, panel: DataFrame, build: str = "GRCh38", how: str = "left_semi") -> DataFrame:
    return df.join(sized(panel_keys(panel, build)), "variant_code", how)


def with_panel_mask(df: DataFrame, panel: DataFrame, build: str = "GRCh38") -> DataFrame:
    keys = panel_keys(panel, build).withColumn("in_panel", F.lit(True))
    return df.join(sized(keys), "variant_code", "left").withColumn("in_panel", F.coalesce("in_panel", F.lit(False)))


def spread(key: Column) -> Column:
    """A key for a left join: rows without one get values of their own, which nothing equals, and don't meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))


def ordered_regions(regions: DataFrame) -> DataFrame:
    """Regions with their rank in genome order; they are few, and dealt by range."""
    from .rowid import with_row_id

    order = F.array_position(F.array(*map(F.lit, builds.CHROMOSOMES)), F.col("chromosome")).cast("int")
    return with_row_id(regions.withColumn("_order", order), ["_order", "start"], "rank", first=1).drop("_order")


def id_membership(df: DataFrame, panel: DataFrame, build: str = "GRCh38") -> DataFrame:
    """Rows whose id is in the panel and agrees with a valid identity, or whose own key is in it."""
    ids = panel.select(identity.normalize_key(F.col("variant_id")).alias("_pid")).where("_pid <> ''").distinct()
    key = F.when(F.col("variant_code").isNotNull(), identity.variant_key(F.col("chromosome"), F.col("base_pair_location"), F.col("other_allele"), F.col("effect_allele")))
    # an id that agrees with the key is the key, so that ids count only where there is none: one key a row
    asked = df.withColumn("_key", F.coalesce(key, identity.normalize_key(F.col("variant_id"))))
    return asked.join(sized(ids), F.col("_key") == F.col("_pid"), "left_semi").drop("_key")


def legacy_membership(df: DataFrame, panel: DataFrame) -> DataFrame:
    """Rows that share an id, an rsID or a coordinate with a panel that isn't canonical."""
    norm = lambda c: identity.normalize_key(F.col(c))
    ids = panel.select(norm("variant_id").alias("k")).where("k <> ''").distinct()
    rs = panel.select(norm("rsid").alias("k")).union(ids.where("k rlike '^RS'")).where("k <> ''").distinct() if "rsid" in panel.columns else ids.where("k rlike '^RS'")
    places = panel.select(F.concat_ws(":", F.col("chromosome"), F.col("base_pair_location").cast("string")).alias("k")).where("k <> ''").distinct()
    out = df
    found: Column = F.lit(False)
    sides = [("_a", norm("variant_id"), ids), ("_c", F.when(F.col("base_pair_location").isNotNull(), F.concat_ws(":", F.col("chromosome"), F.col("base_pair_location").cast("bigint").cast("string"))), places)]
    if "rsid" in df.columns:
        sides.insert(1, ("_b", norm("rsid"), rs))
    for name, key, keys in sides:
        out = out.withColumn(name, spread(key)).join(sized(keys.select(F.col("k").alias(name), F.lit(True).alias(f"{name}_hit"))), name, "left")
        found = found | F.col(f"{name}_hit").isNotNull()
    return out.where(found).drop(*(c for name, _, _ in sides for c in (name, f"{name}_hit")))


SELECTIONS = ["full", "core", "hm3", "pvalue_regions", "core_plus"]


def select_variants(df: DataFrame, selection: str = "full", panel: DataFrame | None = None, threshold: float = 1e-5, padding: int = 10_000, build: str = "GRCh38") -> tuple[DataFrame, DataFrame | None]:
    """(selected rows, regions or None), on statistics before any encoding."""
    if selection not in SELECTIONS:
        raise ValueError(f"selection has to be one of {', '.join(SELECTIONS)}")
    if selection == "full":
        return df, None
    if selection in ("core", "hm3", "core_plus") and panel is None:
        raise ValueError(f"selection {selection!r} needs a panel")
    if selection == "hm3":
        if "hm3" not in panel.columns:
            raise ValueError("the panel has no hm3 column")
        return in_panel(df, panel.where(F.col("hm3").cast("boolean")), build), None
    if selection == "core":
        return in_panel(df, panel, build), None
    regions = pvalue_regions(df, threshold, padding)
    if selection == "pvalue_regions":
        return in_regions(df, regions), regions
    masked = with_region_mask(with_panel_mask(df, panel, build), regions)
    return masked.where("in_panel or in_region").drop("in_panel", "in_region"), regions
