"""The catalogue: each query as an operator's application to the derived study, beside SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import builds, identity, stats
from ..operators import codec, harmonise, qc, select
from ..operators.rowid import position_gaps, positions_from_gaps
from ..sources import blocks, scratch, store
from . import oracle as O
from . import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DECIMALS = 9


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: str | object, digits: int = DECIMALS):
    """Cut to decimals as the SQL is."""
    value, scale = F.col(c) if isinstance(c, str) else c, float(10**digits)
    return F.floor(value * scale + O.NUDGE) / scale


# identity


@query(O.sql("SELECT ordinal, variant_code, global_position, substitution FROM k", *O.BASE))
def identity_encode(spark, sf_dir):
    k = view.prepared(spark, sf_dir)
    return k.select("ordinal", "variant_code", "global_position", F.col("substitution").cast("int").alias("substitution"))


@query(O.sql("SELECT ordinal, chromosome, base_pair_location, reference_allele, alternate_allele FROM k", *O.BASE))
def identity_decode(spark, sf_dir):
    k = view.prepared(spark, sf_dir).select("ordinal", "variant_code")
    place, sub = (F.col("variant_code") / 16).cast("bigint"), F.col("variant_code").bitwiseAND(15)
    (chromosome, position), (ref, alt) = identity.decode_position(place), identity.decode_alleles(sub)
    return k.select("ordinal", chromosome.alias("chromosome"), position.alias("base_pair_location"), ref.alias("reference_allele"), alt.alias("alternate_allele"))


@query(O.sql("SELECT ordinal, chromosome || ':' || base_pair_location || ':' || reference_allele || ':' || alternate_allele AS variant_key FROM k", *O.BASE))
def variant_key(spark, sf_dir):
    k = view.prepared(spark, sf_dir)
    return k.select("ordinal", identity.variant_key(*(F.col(c) for c in ("chromosome", "base_pair_location", "reference_allele", "alternate_allele"))).alias("variant_key"))


@query(O.sql("SELECT chromosome AS source_name, c AS chromosome, count(*) AS n FROM n GROUP BY 1, 2", O.N))
def chromosome_normalise(spark, sf_dir):
    g = view.study(spark, sf_dir)
    return g.groupBy(F.col("chromosome").alias("source_name")).agg(F.count("*").alias("n")).select("source_name", identity.normalize_chromosome(F.col("source_name")).alias("chromosome"), "n")


@query(O.sql("SELECT substitution, count(*) AS n FROM k GROUP BY 1", *O.BASE))
def allele_substitution_counts(spark, sf_dir):
    return view.prepared(spark, sf_dir).groupBy(F.col("substitution").cast("int").alias("substitution")).agg(F.count("*").alias("n"))


# quality control


@query(O.sql("SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM q) GROUP BY 1", O.N, O.Q))
def qc_reason_counts(spark, sf_dir):
    return qc.reason_counts(view.checked(spark, sf_dir))


@query(O.sql("SELECT ordinal, array_to_string(reasons, ',') AS reasons, kept FROM q WHERE len(reasons) > 0", O.N, O.Q))
def qc_rejected_rows(spark, sf_dir):
    return view.checked(spark, sf_dir).where(F.size("reasons") > 0).select("ordinal", F.array_join("reasons", ",").alias("reasons"), "kept")


@query(O.sql("SELECT ordinal, variant_code FROM q WHERE kept", O.N, O.Q))
def qc_kept_rows(spark, sf_dir):
    return view.checked(spark, sf_dir).where("kept").select("ordinal", "variant_code")


@query(O.sql("SELECT reason, ordinal, CAST(rank AS BIGINT) AS rank FROM (SELECT reason, ordinal, row_number() OVER (PARTITION BY reason ORDER BY ordinal) AS rank FROM (SELECT ordinal, unnest(reasons) AS reason FROM q)) WHERE rank <= 5", O.N, O.Q))
def qc_examples(spark, sf_dir):
    return qc.reason_examples(view.checked(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query(O.sql("SELECT count(*) AS input_rows, count(*) FILTER (kept) AS accepted_rows, count(*) FILTER (len(reasons) > 0) AS rejected_rows, count(*) FILTER (NOT kept) AS dropped_rows FROM q", O.N, O.Q))
def qc_accounting(spark, sf_dir):
    n = lambda c: F.sum(c.cast("bigint"))
    return view.checked(spark, sf_dir).agg(F.count("*").alias("input_rows"), n(F.col("kept")).alias("accepted_rows"), n(F.size("reasons") > 0).alias("rejected_rows"), n(~F.col("kept")).alias("dropped_rows"))


_SAFETY = {
    "invalid_primary_chromosome": f"chromosome NOT IN ({O._PRIMARY})",
    "nonfinite_coordinate": f"chromosome IN ({O._PRIMARY}) AND base_pair_location IS NULL",
    "noninteger_coordinate": "false",
    "coordinate_out_of_range": f"chromosome IN ({O._PRIMARY}) AND (base_pair_location < 1 OR base_pair_location > {O.size('chromosome')})",
    "invalid_allele": "NOT (reference_allele IN ('A','C','G','T') AND alternate_allele IN ('A','C','G','T'))",
    "same_alleles": "reference_allele IN ('A','C','G','T') AND reference_allele = alternate_allele",
}


@query(O.sql(" UNION ALL ".join(f"SELECT '{k}' AS reason, count(*) AS n FROM g WHERE {v}" for k, v in _SAFETY.items()), "one AS (SELECT 1)"))
def qc_identity_safety_counts(spark, sf_dir):
    masks = qc.identity_safety(view.study(spark, sf_dir))
    counted = view.study(spark, sf_dir).agg(*(F.sum(F.coalesce(m, F.lit(False)).cast("bigint")).alias(k) for k, m in masks.items()))
    return counted.unpivot([], list(masks), "reason", "n")


@query(O.sql("SELECT variant_code, count(*) AS copies FROM q WHERE variant_code IS NOT NULL GROUP BY 1 HAVING count(*) > 1", O.N, O.Q))
def duplicate_groups(spark, sf_dir):
    return qc.duplicate_keys(qc.with_parts(view.study(spark, sf_dir)).select(qc.part_key().alias("variant_code")))


@query(O.sql("SELECT ordinal, variant_code FROM q WHERE again AND kept", O.N, O.Q))
def duplicate_survivors(spark, sf_dir):
    return view.checked(spark, sf_dir).where(F.array_contains("reasons", "duplicate_variant") & F.col("kept")).select("ordinal", "variant_code")


@query(O.sql("SELECT count(*) AS n_rows, count(*) FILTER (effect_allele_frequency BETWEEN 0 AND 1) AS present, count(*) FILTER (effect_allele_frequency IS NULL) AS missing, count(*) FILTER (effect_allele_frequency < 0 OR effect_allele_frequency > 1) AS invalid, round(count(*) FILTER (effect_allele_frequency BETWEEN 0 AND 1) / CAST(count(*) AS DOUBLE), 9) AS coverage FROM g", "one AS (SELECT 1)"))
def eaf_coverage(spark, sf_dir):
    return qc.eaf_coverage(view.study(spark, sf_dir)).withColumn("coverage", r("coverage"))


@query(O.sql("SELECT count(*) AS n_rows, count(*) FILTER (p_source = 'supplied') AS supplied, count(*) FILTER (p_source = 'derived') AS derived, count(*) FILTER (p_value IS NULL) AS missing, count(*) FILTER (p_value < 0 OR p_value > 1) AS invalid, count(*) FILTER (p_source = 'unresolved') AS unresolved, count(*) FILTER (p_resolved <= 1e-5) AS hits FROM p", *O.RESOLVED))
def pvalue_provenance(spark, sf_dir):
    return select.p_provenance(view.prepared(spark, sf_dir), 1e-5)


# statistics


@query(O.sql("SELECT ordinal, round(z, 9) AS z FROM n WHERE z IS NOT NULL", O.N))
def resolve_z(spark, sf_dir):
    return view.with_z(view.study(spark, sf_dir)).where("z is not null").select("ordinal", r("z").alias("z"))


@query(O.sql("SELECT ordinal, round(ln(odds_ratio), 9) AS beta FROM (SELECT ordinal, exp(beta) AS odds_ratio FROM g WHERE beta IS NOT NULL) WHERE odds_ratio > 0", "one AS (SELECT 1)"))
def resolve_beta_from_or(spark, sf_dir):
    from ..operators.resolve import resolve

    g = view.study(spark, sf_dir).where("beta is not null").select("ordinal", F.exp("beta").alias("OR"))
    return resolve(g.withColumn("chromosome", F.lit("1")), check=False).data.select("ordinal", r("beta").alias("beta"))


@query(O.sql("SELECT ordinal, round(power(10e0, -lp), 9) AS p_value FROM (SELECT ordinal, -log10(p_value) AS lp FROM g WHERE p_value > 0)", "one AS (SELECT 1)"))
def resolve_p_from_mlog10p(spark, sf_dir):
    from ..operators.resolve import resolve

    g = view.study(spark, sf_dir).where("p_value > 0").select("ordinal", (-F.log10("p_value")).alias("LP"))
    return resolve(g, check=False).data.select("ordinal", r("p_value").alias("p_value"))


@query(O.sql("SELECT count(*) AS compared, count(*) FILTER (abs(beta - z2 * standard_error) > 1e-6 + 0.01e0 * greatest(abs(beta), abs(z2 * standard_error))) AS conflicts FROM (SELECT *, CASE WHEN ordinal % 7 = 0 THEN z * 1.05e0 ELSE z END AS z2 FROM n WHERE z IS NOT NULL)", O.N))
def z_consistency_conflicts(spark, sf_dir):
    n = view.with_z(view.study(spark, sf_dir)).where("z is not null").withColumn("z2", F.when(F.col("ordinal") % 7 == 0, F.col("z") * 1.05).otherwise(F.col("z")))
    implied = F.col("z2") * F.col("standard_error")
    off = F.abs(F.col("beta") - implied) > 1e-6 + 0.01 * F.greatest(F.abs("beta"), F.abs(implied))
    return n.agg(F.count("*").alias("compared"), F.sum(off.cast("bigint")).alias("conflicts"))


@query(O.sql(f"SELECT ordinal, round(-log10({O.P_FROM_Z}), 8) AS minus_log10_p FROM k", *O.BASE))
def p_from_z(spark, sf_dir):
    return view.prepared(spark, sf_dir).select("ordinal", stats.two_sided_p("z").alias("p")).select("ordinal", r(-F.log10("p"), 8).alias("minus_log10_p"))


@query(O.sql("SELECT ordinal, round(abs(beta) / x, 9) AS se FROM x", *O.BASE, O.QUANTILE))
def se_from_p(spark, sf_dir):
    k = view.prepared(spark, sf_dir).where("p_value > 0 and p_value < 1 and beta <> 0")
    return k.select("ordinal", r(stats.se_from_p("beta", "p_value")).alias("se"))


# selection


@query(O.sql("SELECT ordinal, variant_code, p_source FROM p WHERE p_resolved <= 1e-5", *O.RESOLVED))
def pvalue_seeds(spark, sf_dir):
    return select.seeds(view.prepared(spark, sf_dir), 1e-5).select("ordinal", "variant_code", "p_source")


@query(O.sql("SELECT chromosome, region_start, region_end, seed_snps FROM r", *O.RESOLVED, O.regions("1e-5", 50_000)))
def pvalue_regions_merged(spark, sf_dir):
    found = select.pvalue_regions(view.prepared(spark, sf_dir), 1e-5, 50_000)
    return found.select("chromosome", F.col("start").alias("region_start"), F.col("end").alias("region_end"), "seed_snps")


@query(O.sql(f"SELECT ordinal, variant_code FROM p x WHERE {O.IN_REGION}", *O.RESOLVED, O.regions("1e-5", 10_000)))
def pvalue_region_rows(spark, sf_dir):
    k = view.prepared(spark, sf_dir)
    return select.select_variants(k, "pvalue_regions")[0].select("ordinal", "variant_code")


@query(O.sql(f"SELECT ordinal, variant_code FROM k WHERE {O.IN_PANEL}", *O.BASE, O.PANEL))
def panel_core(spark, sf_dir):
    return select.select_variants(view.prepared(spark, sf_dir), "core", view.panel(spark, sf_dir))[0].select("ordinal", "variant_code")


@query(O.sql(f"SELECT ordinal, variant_code FROM k WHERE {O.IN_PANEL[:-1]} WHERE hm3)", *O.BASE, O.PANEL))
def panel_hm3(spark, sf_dir):
    return select.select_variants(view.prepared(spark, sf_dir), "hm3", view.panel(spark, sf_dir))[0].select("ordinal", "variant_code")


@query(O.sql(f"SELECT ordinal, variant_code FROM k WHERE NOT {O.IN_PANEL}", *O.BASE, O.PANEL).replace("WHERE NOT variant_code", "WHERE variant_code NOT"))
def panel_anti(spark, sf_dir):
    return select.in_panel(view.prepared(spark, sf_dir), view.panel(spark, sf_dir), how="left_anti").select("ordinal", "variant_code")


@query(O.sql(f"SELECT chromosome, base_pair_location, reference_allele, alternate_allele, round(beta, 9) AS beta, round(standard_error, 9) AS standard_error, ordinal FROM p x WHERE {O.IN_PANEL} OR {O.IN_REGION}", *O.RESOLVED, O.PANEL, O.regions("1e-5", 10_000)))
def core_plus(spark, sf_dir):
    k = view.prepared(spark, sf_dir)
    kept, _ = select.select_variants(k, "core_plus", view.panel(spark, sf_dir))
    return kept.select("chromosome", "base_pair_location", "reference_allele", "alternate_allele", r("beta").alias("beta"), r("standard_error").alias("standard_error"), "ordinal")


@query(O.sql(f"SELECT count(*) AS input_rows, count(*) FILTER (c) AS core_rows, count(*) FILTER (w) AS region_rows, count(*) FILTER (c OR w) AS kept, count(*) FILTER (NOT (c OR w)) AS dropped FROM (SELECT {O.IN_PANEL} AS c, {O.IN_REGION} AS w FROM p x)", *O.RESOLVED, O.PANEL, O.regions("1e-5", 10_000)))
def selection_accounting(spark, sf_dir):
    k = view.prepared(spark, sf_dir)
    masked = select.with_region_mask(select.with_panel_mask(k, view.panel(spark, sf_dir)), select.pvalue_regions(k, 1e-5, 10_000))
    n = lambda e: F.sum(F.expr(e).cast("bigint"))
    return masked.agg(F.count("*").alias("input_rows"), n("in_panel").alias("core_rows"), n("in_region").alias("region_rows"), n("in_panel or in_region").alias("kept"), n("not (in_panel or in_region)").alias("dropped"))


_IDS = "CASE WHEN ordinal % 5 = 0 THEN 'rs' || ordinal WHEN ordinal % 5 = 1 THEN 'chr' || chromosome || ':' || base_pair_location || ':' || reference_allele || ':' || alternate_allele END"


@query(O.sql(f"SELECT ordinal FROM ids WHERE upper(regexp_replace(trim(variant_id), '^chr', '', 'i')) IN (SELECT upper(regexp_replace(trim(variant_id), '^chr', '', 'i')) FROM lp) OR chromosome || ':' || base_pair_location IN (SELECT chromosome || ':' || base_pair_location FROM lp)", *O.BASE, f"ids AS (SELECT *, {_IDS} AS variant_id FROM k), lp AS (SELECT * FROM ids WHERE ordinal % 50 = 0)"))
def legacy_membership(spark, sf_dir):
    ids = view.prepared(spark, sf_dir).withColumn("variant_id", F.expr(_IDS))
    panel = ids.where("ordinal % 50 = 0").select("variant_id", "chromosome", "base_pair_location")
    return select.legacy_membership(ids, panel).select("ordinal")


@query(O.sql("SELECT ordinal FROM ids WHERE (nid IN (SELECT nid FROM lp) AND nid = key) OR key IN (SELECT nid FROM lp)", *O.BASE, f"i0 AS (SELECT *, {_IDS} AS variant_id FROM k), ids AS (SELECT *, upper(regexp_replace(trim(variant_id), '^chr', '', 'i')) AS nid, chromosome || ':' || base_pair_location || ':' || other_allele || ':' || effect_allele AS key FROM i0), lp AS (SELECT nid FROM ids WHERE ordinal % 20 = 1 AND nid IS NOT NULL)"))
def id_membership(spark, sf_dir):
    ids = view.prepared(spark, sf_dir).withColumn("variant_id", F.expr(_IDS))
    return select.id_membership(ids, ids.where("ordinal % 20 = 1").select("variant_id")).select("ordinal")


# codec


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.resolve_p(view.numbered(spark, sf_dir))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode(_numbered(spark, sf_dir))


@query(O.sql("SELECT ordinal, z_code FROM e", *O.ENCODED))
def encode_z_codes(spark, sf_dir):
    return _encoded(spark, sf_dir).select("ordinal", F.col("z_code").cast("int").alias("z_code"))


@query(O.sql("SELECT ordinal, eaf_code FROM e", *O.ENCODED))
def encode_eaf_codes(spark, sf_dir):
    return _encoded(spark, sf_dir).select("ordinal", F.col("eaf_code").cast("int").alias("eaf_code"))


@query(O.sql("SELECT ordinal, se_code, flags FROM e", *O.ENCODED))
def encode_se_codes(spark, sf_dir):
    return _encoded(spark, sf_dir).select("ordinal", F.col("se_code").cast("int").alias("se_code"), F.coalesce(F.col("exc_flags").cast("int"), F.lit(0)).alias("flags"))


@query(O.sql("SELECT block_id, round(se_centre, 9) AS se_centre FROM e2", *O.ENCODED))
def block_centres(spark, sf_dir):
    from ..operators.rowid import with_blocks

    return codec.block_centres(codec.with_residual(with_blocks(_numbered(spark, sf_dir)))).select("block_id", r("se_centre").alias("se_centre"))


@query(O.sql("SELECT ordinal, z_code, eaf_code, se_code FROM leg", *O.LEGACY))
def legacy_encode_codes(spark, sf_dir):
    e = codec.encode(_numbered(spark, sf_dir), codec.LEGACY)
    return e.select("ordinal", *(F.col(c).cast("int").alias(c) for c in ("z_code", "eaf_code", "se_code")))


@query(O.sql("SELECT count(*) AS n_rows, round(max(abs(dz - z)), 6) AS z_error, round(max(abs(deaf - effect_allele_frequency)), 6) AS eaf_error, round(max(abs(dse / standard_error - 1e0)), 6) AS se_error FROM d", *O.DECODED))
def decode_roundtrip_error(spark, sf_dir):
    e = _encoded(spark, sf_dir).withColumns({"z0": F.col("z"), "eaf0": F.col("effect_allele_frequency"), "se0": F.col("standard_error")})
    d = codec.decode(e, derived=False)
    err = lambda c: r(F.max(F.abs(c)), 6)
    return d.agg(F.count("*").alias("n_rows"), err(F.col("z") - F.col("z0")).alias("z_error"), err(F.col("effect_allele_frequency") - F.col("eaf0")).alias("eaf_error"), err(F.col("standard_error") / F.col("se0") - 1).alias("se_error"))


@query(O.sql("SELECT row_id, flags, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 6) AS z, round(CAST(CAST(effect_allele_frequency AS FLOAT) AS DOUBLE), 6) AS eaf FROM e WHERE flags > 0", *O.ENCODED))
def exceptions_table(spark, sf_dir):
    e = _encoded(spark, sf_dir).where("exc_flags is not null")
    return e.select("row_id", F.col("exc_flags").cast("int").alias("flags"), r(F.col("exc_z").cast("double"), 6).alias("z"), r(F.col("exc_eaf").cast("double"), 6).alias("eaf"))


@query(O.sql("SELECT count(*) AS n_rows, count(*) FILTER (flags > 0) AS exceptions, count(*) FILTER (flags & 1 <> 0) AS z_exceptions, count(*) FILTER (flags & 2 <> 0) AS se_exceptions, count(*) FILTER (flags & 4 <> 0) AS eaf_exceptions, round(count(*) FILTER (flags > 0) / CAST(count(*) AS DOUBLE), 9) AS density FROM e", *O.ENCODED))
def exception_flag_counts(spark, sf_dir):
    return codec.exception_counts(_encoded(spark, sf_dir)).withColumn("density", r("density"))


# rows and blocks


@query(O.sql("SELECT row_id, variant_code, CAST(floor(row_id / 65536) AS INTEGER) AS block_id FROM rows_", *O.RESOLVED, O.ROWS))
def row_ids(spark, sf_dir):
    from ..operators.rowid import with_blocks

    return with_blocks(_numbered(spark, sf_dir)).select("row_id", "variant_code", "block_id")


@query(O.sql("SELECT row_id, coalesce(global_position - lag(global_position) OVER (PARTITION BY floor(row_id / 131072) ORDER BY row_id), 0) AS gap FROM rows_", *O.RESOLVED, O.ROWS))
def position_gaps_by_block(spark, sf_dir):
    return position_gaps(_numbered(spark, sf_dir)).select("row_id", "gap")


@query(O.sql("SELECT row_id, global_position AS restored_position FROM rows_", *O.RESOLVED, O.ROWS))
def position_gaps_roundtrip(spark, sf_dir):
    n = _numbered(spark, sf_dir)
    block = F.floor(F.col("row_id") / 131_072)
    starts = n.groupBy(block.alias("b")).agg(F.min("global_position").alias("first_position"))
    gaps = position_gaps(n).withColumn("b", block).join(starts, "b")
    return positions_from_gaps(gaps).select("row_id", "restored_position")


# the store


def _store(spark: SparkSession, sf_dir: str, name: str = "store", shift: bool = False, **options) -> store.Store:
    """Written once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, view.stamp(spark, sf_dir), name)
    if key not in _STORES:
        k = view.prepared(spark, sf_dir)
        if shift:
            beta = F.col("beta") * 0.9 + 0.001
            k = k.withColumn("beta", beta).withColumn("z", F.col("beta") / F.col("standard_error"))
        _STORES[key] = store.write_store(k, scratch.new_path(spark, name), **options)
    return _STORES[key]


_STORES: dict[tuple[str, str, str, str], store.Store] = {}
_READ = "chromosome, base_pair_location, reference_allele, alternate_allele, round(dz, 6) AS z, round(dse, 6) AS standard_error, round(deaf, 6) AS effect_allele_frequency, round(dbeta, 6) AS beta"


def _shown(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(r(c, digits).alias(c) if c in ("z", "standard_error", "effect_allele_frequency", "beta", "p_value") else c for c in df.columns))


_COLS = ["chromosome", "base_pair_location", "reference_allele", "alternate_allele", "z", "standard_error", "effect_allele_frequency", "beta"]


@query(O.sql(f"SELECT {_READ}, row_id FROM d", *O.DECODED))
def store_full_read(spark, sf_dir):
    return _shown(_store(spark, sf_dir).read(columns=[*_COLS, "row_id"], ordered=False))


@query(O.sql(f"SELECT {_READ} FROM d WHERE chromosome = '1' AND base_pair_location BETWEEN 400000 AND 900000", *O.DECODED))
def region_read(spark, sf_dir):
    return _shown(_store(spark, sf_dir).read("chr1:400000-900000", columns=_COLS))


@query(O.sql(f"SELECT {_READ} FROM d WHERE row_id % 97 = 0", *O.DECODED))
def key_read(spark, sf_dir):
    keys = _numbered(spark, sf_dir).where("row_id % 97 = 0").select("variant_code")
    return _shown(_store(spark, sf_dir).read(variants=keys, columns=_COLS))


@query(O.sql(f"SELECT row_id, {_READ} FROM d WHERE row_id IN (0, 3, 17, 1000, 4999)", *O.DECODED))
def row_read(spark, sf_dir):
    return _shown(_store(spark, sf_dir).read(variants=[0, 3, 17, 1000, 4999], columns=["row_id", *_COLS]))


@query(O.sql("SELECT global_position, round(dz, 6) AS z FROM d", *O.DECODED))
def projection_read(spark, sf_dir):
    return _shown(_store(spark, sf_dir).read(columns=["global_position", "z"], ordered=False))


@query(O.sql(f"SELECT {_READ} FROM d WHERE chromosome = '7' AND base_pair_location BETWEEN 1 AND 1500000 AND row_id % 13 = 0", *O.DECODED))
def combined_read(spark, sf_dir):
    keys = _numbered(spark, sf_dir).where("row_id % 13 = 0").select("variant_code")
    return _shown(_store(spark, sf_dir).read(("7", 1, 1_500_000), keys, _COLS))


@query(O.sql("SELECT row_id FROM rows_ WHERE p_resolved <= 5e-8", *O.RESOLVED, O.ROWS))
def pvalue_flag_rows(spark, sf_dir):
    return _store(spark, sf_dir).pvalue_flag()


@query(O.sql(f"SELECT {_READ} FROM d WHERE p_resolved <= 5e-8", *O.DECODED))
def flag_then_fetch(spark, sf_dir):
    return _shown(_store(spark, sf_dir).fetch_flagged(_COLS))


_TWO = "SELECT 'first' AS study, row_id, round(z, 9) AS z, round(beta, 9) AS beta FROM rows_ WHERE row_id % 50 = 0 UNION ALL SELECT 'second', row_id, round((beta * 0.9e0 + 0.001e0) / standard_error, 9), round((beta * 0.9e0 + 0.001e0) / standard_error * standard_error, 9) FROM rows_ WHERE row_id % 50 = 0"


@query(O.sql(_TWO.replace("round(beta, 9)", "round(z * standard_error, 9)"), *O.RESOLVED, O.ROWS))
def batch_two_studies(spark, sf_dir):
    stores = {"first": _store(spark, sf_dir, "exact", profile="exact"), "second": _store(spark, sf_dir, "exact2", shift=True, profile="exact")}
    keys = _numbered(spark, sf_dir).where("row_id % 50 = 0").select("variant_code")
    return _shown(store.read_batch(stores, keys, columns=["row_id", "z", "beta"]), 9)


@query(O.sql("SELECT row_id, round(z, 9) AS z, round(standard_error, 9) AS standard_error, round(effect_allele_frequency, 9) AS effect_allele_frequency FROM rows_", *O.RESOLVED, O.ROWS))
def store_parquet_exact(spark, sf_dir):
    return _shown(_store(spark, sf_dir, "exact", profile="exact").read(columns=["row_id", "z", "standard_error", "effect_allele_frequency"], ordered=False), 9)


@query(O.sql("SELECT true AS valid, count(*) AS n_rows, min(row_id) AS first_row, max(row_id) AS last_row, count(DISTINCT floor(row_id / 65536)) AS n_blocks, min(variant_code) AS first_variant, max(variant_code) AS last_variant FROM rows_", *O.RESOLVED, O.ROWS))
def store_validate(spark, sf_dir):
    """What validation found in the stored files, after their digests."""
    found = _store(spark, sf_dir).validate()
    names = ["valid", "n_rows", "first_row", "last_row", "n_blocks", "first_variant", "last_variant"]
    return spark.createDataFrame([tuple(found[k] for k in names)], "valid boolean, " + ", ".join(f"{k} long" for k in names[1:]))


@query(O.sql("SELECT row_id, variant_code, round(cz, 6) AS z, round(ceaf, 6) AS effect_allele_frequency FROM c", *O.DECODED, O.Q8))
def q8_cache_read(spark, sf_dir):
    """The values of the cache at eight bits."""
    s = _store(spark, sf_dir)
    s.build_cache()
    return _shown(s.read(columns=["row_id", "variant_code", "z", "effect_allele_frequency"], ordered=False, use_cache=True))


# text sources


@query(O.sql("SELECT chromosome, base_pair_location, reference_allele, alternate_allele, round(beta, 9) AS beta, round(standard_error, 9) AS standard_error, round(z, 9) AS z FROM k", *O.BASE))
def ingest_tsv_gz(spark, sf_dir):
    from ..api import import_sumstats

    names = {"CHR": "chromosome", "GENPOS": "base_pair_location", "REF": "reference_allele", "ALT": "alternate_allele", "ALLELE1": "effect_allele", "ALLELE0": "other_allele", "BETA": "beta", "SE": "standard_error", "A1FREQ": "effect_allele_frequency"}
    path = scratch.new_path(spark, "study.tsv.gz")
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names.values()))
    blocks.write_lines(view.prepared(spark, sf_dir).select(line.alias("value")), ["\t".join(names)], path, "gz")
    data = import_sumstats(spark, path).data
    return _shown(data.select("chromosome", F.col("base_pair_location").cast("bigint").alias("base_pair_location"), "reference_allele", "alternate_allele", "beta", "standard_error", "z"), 9)


@query(O.sql("SELECT chromosome, base_pair_location, reference_allele, alternate_allele, round(beta, 9) AS beta, round(standard_error, 9) AS standard_error, round(effect_allele_frequency, 9) AS effect_allele_frequency FROM k", *O.BASE))
def ingest_vcf(spark, sf_dir):
    from ..operators.resolve import resolve
    from ..sources.delimited import vcf_fields

    names = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "trait"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    rows = view.prepared(spark, sf_dir).select("ordinal", F.col("chromosome").alias("#CHROM"), F.col("base_pair_location").cast("string").alias("POS"), F.lit(".").alias("ID"), F.col("reference_allele").alias("REF"), F.col("alternate_allele").alias("ALT"), F.lit(".").alias("QUAL"), F.lit("PASS").alias("FILTER"), F.concat(F.lit("AF=0.5;SE="), text("standard_error")).alias("INFO"), F.lit("ES:SE:AF").alias("FORMAT"), F.concat_ws(":", text("beta"), text("standard_error"), text("effect_allele_frequency")).alias("trait"))
    data = resolve(vcf_fields(rows, names)).data
    return _shown(data.select("chromosome", "base_pair_location", "reference_allele", "alternate_allele", "beta", "standard_error", "effect_allele_frequency"), 9)


# harmonisation

_REF = """ref AS (SELECT chromosome, base_pair_location, reference_allele AS ref, alternate_allele AS alt, 'rs' || CAST(ordinal % 1000 AS VARCHAR) AS rsids, effect_allele_frequency AS ref_eaf FROM k WHERE ordinal % 3 <> 0)"""
_STUDY = """st AS (SELECT ordinal, chromosome, base_pair_location, CASE ordinal % 4 WHEN 0 THEN alternate_allele WHEN 1 THEN reference_allele WHEN 2 THEN translate(alternate_allele, 'ACGT', 'TGCA') ELSE translate(reference_allele, 'ACGT', 'TGCA') END AS effect_allele,
  CASE ordinal % 4 WHEN 0 THEN reference_allele WHEN 1 THEN alternate_allele WHEN 2 THEN translate(reference_allele, 'ACGT', 'TGCA') ELSE translate(alternate_allele, 'ACGT', 'TGCA') END AS other_allele, beta, z, effect_allele_frequency FROM k)"""
_CAND = """ca AS (SELECT st.*, t.rank, CASE t.rank WHEN 0 THEN other_allele WHEN 1 THEN effect_allele WHEN 2 THEN translate(other_allele, 'ACGT', 'TGCA') ELSE translate(effect_allele, 'ACGT', 'TGCA') END AS cref,
  CASE t.rank WHEN 0 THEN effect_allele WHEN 1 THEN other_allele WHEN 2 THEN translate(effect_allele, 'ACGT', 'TGCA') ELSE translate(other_allele, 'ACGT', 'TGCA') END AS calt FROM st, (VALUES (0), (1), (2), (3)) t(rank)),
me AS (SELECT ca.ordinal, ca.rank, ref.ref, ref.alt FROM ca JOIN ref ON ca.chromosome = ref.chromosome AND ca.base_pair_location = ref.base_pair_location AND ca.cref = ref.ref AND ca.calt = ref.alt),
fo AS (SELECT ordinal, count(*) AS n, min(rank) AS rank, arg_min(ref, rank) AS ref, arg_min(alt, rank) AS alt FROM me GROUP BY ordinal),
al0 AS (SELECT st.*, fo.rank, fo.ref, fo.alt, CASE WHEN fo.n > 1 THEN 'ambiguous' WHEN fo.n IS NULL THEN 'unmatched' ELSE 'aligned' END AS status0 FROM st LEFT JOIN fo USING (ordinal)),
al AS (SELECT *, CASE WHEN status0 = 'aligned' AND count(*) OVER (PARTITION BY CASE WHEN status0 = 'aligned' THEN chromosome || ':' || base_pair_location || ':' || ref || ':' || alt ELSE 'row ' || ordinal END) > 1 THEN 'duplicate' ELSE status0 END AS status FROM al0)"""
_HARM = (*O.BASE, _REF, _STUDY, _CAND)


def _reference(spark, sf_dir):
    k = view.prepared(spark, sf_dir).where("ordinal % 3 <> 0")
    return k.select("chromosome", "base_pair_location", "reference_allele", "alternate_allele", F.concat(F.lit("rs"), (F.col("ordinal") % 1000).cast("string")).alias("rsids"), F.col("effect_allele_frequency").alias("ref_eaf"))


def _unaligned(spark, sf_dir):
    k = view.prepared(spark, sf_dir)
    ref, alt = F.col("reference_allele"), F.col("alternate_allele")
    comp = identity.complement
    kind = F.col("ordinal") % 4
    effect = F.when(kind == 0, alt).when(kind == 1, ref).when(kind == 2, comp(alt)).otherwise(comp(ref))
    other = F.when(kind == 0, ref).when(kind == 1, alt).when(kind == 2, comp(ref)).otherwise(comp(alt))
    return k.select("ordinal", "chromosome", "base_pair_location", effect.alias("effect_allele"), other.alias("other_allele"), "beta", "z", "effect_allele_frequency")


@query(O.sql("SELECT ordinal, status, CASE WHEN status = 'aligned' THEN ['direct','reverse','complement','complement_reverse'][rank + 1] END AS path FROM al", *_HARM))
def harmonise_align(spark, sf_dir):
    return harmonise.align(_unaligned(spark, sf_dir), _reference(spark, sf_dir)).select("ordinal", "status", "path")


@query(O.sql("SELECT ordinal, ref AS other_allele, alt AS effect_allele, round(CASE WHEN rank IN (1, 3) THEN -beta ELSE beta END, 9) AS beta, round(CASE WHEN rank IN (1, 3) THEN 1e0 - effect_allele_frequency ELSE effect_allele_frequency END, 9) AS effect_allele_frequency FROM al WHERE status = 'aligned'", *_HARM))
def harmonise_flip(spark, sf_dir):
    out = harmonise.align(_unaligned(spark, sf_dir), _reference(spark, sf_dir)).where("status = 'aligned'")
    return _shown(out.select("ordinal", "other_allele", "effect_allele", "beta", "effect_allele_frequency"), 9)


@query(O.sql("SELECT status, count(*) AS n, count(*) FILTER (status = 'aligned' AND rank IN (1, 3)) AS flipped FROM al GROUP BY 1", *_HARM))
def harmonise_status_counts(spark, sf_dir):
    return harmonise.status_counts(harmonise.align(_unaligned(spark, sf_dir), _reference(spark, sf_dir)))


@query(O.sql("SELECT a.ordinal, CASE WHEN t.n IS NULL THEN 'unresolved' WHEN t.n > 1 THEN 'ambiguous' ELSE 'resolved' END AS rsid_status, CASE WHEN t.n = 1 THEN t.chromosome END AS chromosome, CASE WHEN t.n = 1 THEN t.at END AS base_pair_location FROM (SELECT ordinal, 'rs' || CAST(ordinal % 1500 AS VARCHAR) AS rsid FROM k) a LEFT JOIN (SELECT rsids, count(DISTINCT (chromosome, base_pair_location, ref, alt)) AS n, min(chromosome) AS chromosome, min(base_pair_location) AS at FROM ref GROUP BY 1) t ON a.rsid = t.rsids", *O.BASE, _REF))
def rsid_lookup(spark, sf_dir):
    k = view.prepared(spark, sf_dir).select("ordinal", F.concat(F.lit("rs"), (F.col("ordinal") % 1500).cast("string")).alias("rsid"), F.lit(None).cast("string").alias("chromosome"), F.lit(None).cast("bigint").alias("base_pair_location"))
    return harmonise.resolve_rsids(k, _reference(spark, sf_dir)).select("ordinal", "rsid_status", "chromosome", "base_pair_location")


_BLOCKS = "bl AS (SELECT * FROM (VALUES ('1', 0, 500000, '1', 10000, '+'), ('1', 400000, 900000, '1', 800000, '+'), ('2', 0, 1000000, '2', 0, '-'), ('3', 100, 1500000, '4', 5000, '+'), ('5', 0, 700000, 'MT', 0, '+'), ('X', 1000, 1999000, 'X', 2000, '+')) t(source, a, b, target, t0, strand))"


@query(O.sql(f"SELECT ordinal, CASE WHEN n IS NULL THEN 'unmapped' WHEN n > 1 THEN 'multi_mapped' WHEN target NOT IN ({O._PRIMARY}) THEN 'non_primary_target' ELSE 'mapped' END AS lift_status, CASE WHEN n = 1 AND target IN ({O._PRIMARY}) THEN target ELSE chromosome END AS chromosome, CASE WHEN n = 1 AND target IN ({O._PRIMARY}) THEN place ELSE base_pair_location END AS base_pair_location, CASE WHEN n = 1 AND target IN ({O._PRIMARY}) AND strand = '-' THEN translate(effect_allele, 'ACGT', 'TGCA') ELSE effect_allele END AS effect_allele FROM k LEFT JOIN (SELECT ordinal, count(*) AS n, min(target) AS target, min(strand) AS strand, min(CASE WHEN strand = '-' THEN 50000000 - 1 - (t0 + base_pair_location - 1 - a) ELSE t0 + base_pair_location - 1 - a END + 1) AS place FROM k JOIN bl ON k.chromosome = bl.source AND base_pair_location - 1 >= a AND base_pair_location - 1 < b GROUP BY 1) m USING (ordinal)", *O.BASE, _BLOCKS))
def liftover_blocks(spark, sf_dir):
    rows = [("1", 0, 500000, "1", 10000, "+"), ("1", 400000, 900000, "1", 800000, "+"), ("2", 0, 1000000, "2", 0, "-"), ("3", 100, 1500000, "4", 5000, "+"), ("5", 0, 700000, "MT", 0, "+"), ("X", 1000, 1999000, "X", 2000, "+")]
    blocks = spark.createDataFrame(rows, "source string, start long, end long, target string, target_start long, strand string").withColumn("t_size", F.lit(50_000_000).cast("long"))
    return harmonise.lift_over(view.prepared(spark, sf_dir), blocks).select("ordinal", "lift_status", "chromosome", "base_pair_location", "effect_allele")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{c}', CAST({s} AS BIGINT), CAST({builds.offsets(b)[c]} AS BIGINT))" for b in ("GRCh37", "GRCh38") for c, s in builds.lengths(b).items()) + ") t(build, chromosome, n_bases, before)")
def assembly_table(spark, sf_dir):
    rows = [(b, c, s, builds.offsets(b)[c]) for b in ("GRCh37", "GRCh38") for c, s in builds.lengths(b).items()]
    return spark.createDataFrame(rows, "build string, chromosome string, n_bases long, before long")
