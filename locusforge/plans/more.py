"""The rest of the catalogue: text sources, panels, the public functions, stored references and their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import builds, identity
from ..operators import codec, harmonise, qc, resolve, rowid, select
from ..sources import blocks, panel, reference, scratch, store
from . import oracle as O
from . import view
from .queries import _COLS, _numbered, _shown, _store, query, r

_IDENTITY = ["chromosome", "base_pair_location", "reference_allele", "alternate_allele"]
_ID = ", ".join(_IDENTITY)
_ONE = "one AS (SELECT 1)"


def _file(spark: SparkSession, rows: DataFrame, head: list[str], name: str, codec_name: str) -> str:
    """Lines behind head lines, in one compressed file that many tasks write."""
    kind = {"gzip": "gz", "bzip2": "bz2"}.get(codec_name, "none")
    path = scratch.new_path(spark, f"{name}.txt" if kind == "none" else f"{name}.txt.{kind}")
    blocks.write_lines(rows, head, path, kind)
    return path


def _text(*names: str, missing: str = "NA"):
    return [F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in names]


# text sources


_READ_TEXT = f"SELECT {_ID}, effect_allele, round(beta, 9) AS beta, round(standard_error, 9) AS standard_error, round(effect_allele_frequency, 9) AS effect_allele_frequency, round(p_value, 12) AS p_value FROM k"
_TEXT_COLUMNS = ["chromosome", "base_pair_location", "reference_allele", "alternate_allele", "effect_allele", "other_allele", "beta", "standard_error", "effect_allele_frequency", "p_value"]


def _read_text(spark: SparkSession, path: str) -> DataFrame:
    data = api.import_sumstats(spark, path).data
    return data.select(*_IDENTITY, "effect_allele", *(r(c, n).alias(c) for c, n in (("beta", 9), ("standard_error", 9), ("effect_allele_frequency", 9), ("p_value", 12))))


@query(O.sql(_READ_TEXT, *O.BASE))
def ingest_semicolons_bz2(spark, sf_dir):
    """The separator is found in the first line that is no comment, though forty comments come before."""
    rows = view.prepared(spark, sf_dir).select("ordinal", F.concat_ws(";", *_text(*_TEXT_COLUMNS)).alias("value"))
    head = [*(f"## note {i}, a, b" for i in range(40)), "chr;pos;ref;alt;EA;NEA;Effect;StdErr;EAF;Pval"]
    return _read_text(spark, _file(spark, rows, head, "semicolons", "bzip2"))


@query(O.sql(_READ_TEXT, *O.BASE))
def ingest_blanks(spark, sf_dir):
    """Columns apart by any blanks."""
    rows = view.prepared(spark, sf_dir).select("ordinal", F.concat_ws("   ", *_text(*_TEXT_COLUMNS)).alias("value"))
    return _read_text(spark, _file(spark, rows, ["#CHROM  POS REF ALT A1 A2 BETA SE A1FREQ P"], "blanks", "none"))


@query(O.sql(f"SELECT {_ID}, round(beta, 9) AS beta, round(standard_error, 9) AS standard_error, round(effect_allele_frequency, 9) AS effect_allele_frequency, round(p_value, 9) AS p_value, CASE WHEN ordinal % 4 <> 3 THEN 'rs' || ordinal END AS rsid FROM k", *O.BASE))
def ingest_vcf_file(spark, sf_dir):
    """Direct columns before the trait's values, and these before INFO; ratios become effects, and minus log10 p becomes p."""
    k = view.prepared(spark, sf_dir)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    odd = F.col("ordinal") % 2 == 1
    beta, se, eaf, lp = F.col("beta"), F.col("standard_error"), F.col("effect_allele_frequency"), -F.log10("p_value")
    info = F.when(odd, F.concat(F.lit("AF="), text(eaf), F.lit(";SE=99;OR="), text(F.exp(beta)), F.lit(";FLAG"))).otherwise("AF=0.123")
    trait = F.when(odd, F.concat_ws(":", text(se), text(lp))).otherwise(F.concat_ws(":", text(beta), text(se), text(eaf), text(lp)))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chromosome")), F.col("base_pair_location").cast("string"), F.when(F.col("ordinal") % 4 == 3, ".").otherwise(F.concat(F.lit("rs"), F.col("ordinal").cast("string"))), "reference_allele", "alternate_allele", F.lit("."), F.lit("PASS"), info, F.when(odd, "SE:LP").otherwise("ES:SE:AF:LP"), trait)
    head = ["##fileformat=VCFv4.2", *(f"##contig=<ID={c}>" for c in builds.CHROMOSOMES), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ttrait"]
    data = api.import_sumstats(spark, _file(spark, k.select("ordinal", line.alias("value")), head, "vcf", "gzip")).data
    return data.select(identity.normalize_chromosome(F.col("chromosome")).alias("chromosome"), *_IDENTITY[1:], *(r(c).alias(c) for c in ("beta", "standard_error", "effect_allele_frequency", "p_value")), "rsid")


_NUMBERS = "CASE ordinal % 10 WHEN 0 THEN 'NA' WHEN 1 THEN ' 1.5e-3 ' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN CAST(ordinal AS {t}) WHEN 5 THEN '-.5' WHEN 6 THEN 'NaN' WHEN 7 THEN '1,5' WHEN 8 THEN NULL ELSE '12e' END"


@query(O.sql(f"SELECT ordinal, m AS missing, NOT m AND NOT coalesce(num, false) AS failed, CASE WHEN NOT m AND num THEN CAST(trim(t) AS DOUBLE) END AS number FROM (SELECT *, t IS NULL OR lower(trim(t)) IN ('', '.', 'na', 'nan', 'null') AS m, regexp_full_match(trim(t), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AS num FROM (SELECT ordinal, {_NUMBERS.format(t='VARCHAR')} AS t FROM g))", _ONE))
def number_parsing(spark, sf_dir):
    from ..functions.stats import failed_number, is_missing, parse_number

    t = view.study(spark, sf_dir).select("ordinal", F.expr(_NUMBERS.format(t="STRING")).alias("t"))
    return t.select("ordinal", is_missing(F.col("t")).alias("missing"), failed_number(F.col("t")).alias("failed"), parse_number(F.col("t")).alias("number"))


_OTHER = "CASE WHEN ordinal % 13 = 0 THEN beta + 0.1e0 WHEN ordinal % 11 = 0 THEN beta * (1e0 + 1e-14) WHEN ordinal % 17 = 0 THEN NULL ELSE beta END"


@query(O.sql(f"SELECT 'beta' AS preferred, 'ES' AS other, count(*) FILTER ((b IS NULL) <> (o IS NULL) OR abs(b - o) > 1e-12 * greatest(abs(b), abs(o), 1e-300)) AS n FROM (SELECT beta AS b, {_OTHER} AS o FROM g) UNION ALL SELECT 'chromosome', 'CHR', 0", _ONE))
def alias_conflicts(spark, sf_dir):
    """Two source columns of one meaning have to agree, as text or as numbers."""
    g = view.study(spark, sf_dir)
    return resolve.conflict_counts(g.select("chromosome", F.col("chromosome").alias("CHR"), "beta", F.expr(_OTHER).alias("ES"), F.lit(1).alias("junk")))


_SOURCE = ["CHR", "GENPOS", "REF", "ALT", "A1", "A2", "BETA", "SE", "P", "N", "junk", "note"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}')" for k, cs in (("all", _SOURCE[:10]), ("core", _SOURCE[:9]), ("core without p", _SOURCE[:8]), ("nothing known", ["junk"])) for c in cs) + ") t(mode, name)")
def projected_columns(spark, sf_dir):
    frame = spark.createDataFrame([], ", ".join(f"{c} string" for c in _SOURCE))
    modes = {"all": resolve.project(frame), "core": resolve.project(frame, True), "core without p": resolve.project(frame, True, False), "nothing known": resolve.project(frame.select("junk", "note"))}
    return spark.createDataFrame([(k, c) for k, f in modes.items() for c in f.columns], "mode string, name string")


@query(O.sql("SELECT ordinal, round(beta, 9) AS beta, round(standard_error, 9) AS standard_error, round(z, 9) AS z FROM n", O.N))
def trusted_normalise(spark, sf_dir):
    g = view.study(spark, sf_dir)
    named = g.select("ordinal", *(F.col(c).cast("string").alias(c) for c in g.columns if c not in ("ordinal", "z")))
    return resolve.trusted(named).select("ordinal", *(r(c).alias(c) for c in ("beta", "standard_error", "z")))


_GIVEN = "CASE ordinal % 6 WHEN 0 THEN 'rs' || ordinal WHEN 1 THEN 'NA' WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN 'own' || ordinal ELSE 'RS9' END"


@query(O.sql(f"SELECT ordinal, coalesce(given, chromosome || '_' || base_pair_location || '_' || other_allele || '_' || effect_allele) AS variant_id, CASE WHEN given ILIKE 'rs%' THEN given END AS rsid FROM (SELECT *, CASE WHEN ordinal % 6 IN (0, 4, 5) THEN {_GIVEN} END AS given FROM k)", *O.BASE))
def variant_ids(spark, sf_dir):
    return resolve.with_variant_ids(view.prepared(spark, sf_dir).withColumn("variant_id", F.expr(_GIVEN))).select("ordinal", "variant_id", "rsid")


# identity


_KEY = "chromosome || ':' || base_pair_location || ':' || reference_allele || ':' || alternate_allele"
_KEYS = f"CASE ordinal % 5 WHEN 0 THEN lower('chr' || {_KEY}) WHEN 1 THEN {_KEY} WHEN 2 THEN {_KEY} || ':A' WHEN 3 THEN 'MT:1:A:C' ELSE ' ' || {_KEY} || ' ' END"


@query(O.sql("SELECT ordinal, CASE WHEN ok THEN chromosome END AS chromosome, CASE WHEN ok THEN base_pair_location END AS base_pair_location, CASE WHEN ok THEN reference_allele END AS reference_allele, CASE WHEN ok THEN alternate_allele END AS alternate_allele FROM (SELECT *, ordinal % 5 IN (0, 1, 4) AND chromosome <> 'MT' AS ok FROM k)", *O.BASE))
def key_parsing(spark, sf_dir):
    k = identity.parse_key(F.expr(_KEYS))
    parsed = view.prepared(spark, sf_dir).select("ordinal", k.alias("k"))
    return parsed.select("ordinal", F.col("k.chromosome").alias("chromosome"), F.col("k.position").alias("base_pair_location"), F.col("k.reference").alias("reference_allele"), F.col("k.alternate").alias("alternate_allele"))


@query(O.sql("SELECT ordinal, CASE WHEN length(reference_allele) <> length(alternate_allele) THEN 'INDEL' WHEN length(reference_allele) = 1 THEN 'SNV' ELSE 'MNV' END AS variant_type, reference_allele || alternate_allele IN ('AT', 'TA', 'CG', 'GC') AS palindromic FROM g", _ONE))
def variant_types(spark, sf_dir):
    ref, alt = F.col("reference_allele"), F.col("alternate_allele")
    return view.study(spark, sf_dir).select("ordinal", identity.variant_type(ref, alt).alias("variant_type"), identity.is_palindromic(ref, alt).alias("palindromic"))


_NAMES = {"column": {"Effect_Allele": "effectallele", "#CHROM": "#chrom", " -LOG10P ": "log10p", "p.value": "pvalue"}, "build": {"hg19": "GRCh37", "GRCh-38": "GRCh38", "38": "GRCh38", "b37": "unknown"}}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, t in _NAMES.items() for a, b in t.items()) + ") t(kind, name, normal)")
def name_normalisation(spark, sf_dir):
    def build(name: str) -> str:
        try:
            return builds.normalize_build(name)
        except ValueError:
            return "unknown"

    rule = {"column": resolve.alias_key, "build": build}
    return spark.createDataFrame([(k, a, rule[k](a)) for k, t in _NAMES.items() for a in t], "kind string, name string, normal string")


# quality control


@query(O.sql("SELECT 'input_rows' AS what, count(*) AS n FROM q UNION ALL SELECT 'accepted_rows', count(*) FROM q WHERE kept UNION ALL SELECT 'rejected_rows', count(*) FROM q WHERE len(reasons) > 0 UNION ALL SELECT 'dropped_rows', count(*) FROM q WHERE NOT kept UNION ALL SELECT reason, count(*) FROM (SELECT unnest(reasons) AS reason FROM q) GROUP BY 1", O.N, O.Q))
def preflight_report(spark, sf_dir):
    found = api.preflight(spark, view.study(spark, sf_dir)).report
    rows = {"input_rows": found.input_rows, "accepted_rows": found.accepted_rows, "rejected_rows": found.rejected_rows, "dropped_rows": found.dropped_rows, **found.rejections}
    return spark.createDataFrame(list(rows.items()), "what string, n long")


@query(O.sql("SELECT 'beta is missing or not finite' AS fault, count(*) FILTER (beta IS NULL) AS n FROM n UNION ALL SELECT 'z is missing or not finite', count(*) FILTER (z IS NULL) FROM n UNION ALL SELECT 'standard_error isn''t finite and positive', count(*) FILTER (standard_error IS NULL OR standard_error <= 0) FROM n UNION ALL SELECT 'effect_allele_frequency lies out of [0, 1]', count(*) FILTER (effect_allele_frequency < 0 OR effect_allele_frequency > 1) FROM n", O.N))
def value_faults(spark, sf_dir):
    return qc.fault_counts(view.with_z(view.study(spark, sf_dir)))


@query(O.sql("SELECT ordinal FROM g WHERE effect_allele <> alternate_allele OR other_allele <> reference_allele", _ONE))
def misoriented_rows(spark, sf_dir):
    return qc.misoriented(view.study(spark, sf_dir)).select("ordinal")


# codec and rows


@query(O.sql("SELECT row_id, round(dz, 6) AS z, round(deaf, 6) AS effect_allele_frequency, round(dse, 6) AS standard_error FROM ld", *O.LEGACY))
def legacy_decode_values(spark, sf_dir):
    out = codec.decode(codec.encode(_numbered(spark, sf_dir), codec.LEGACY), codec.LEGACY, derived=False)
    return _shown(out.select("row_id", "z", "effect_allele_frequency", "standard_error"))


@query(O.sql("SELECT row_id FROM rows_ WHERE row_id % 1000 BETWEEN 1 AND 5", *O.RESOLVED, O.ROWS))
def bad_code_rows(spark, sf_dir):
    """Codes out of their domains are found, each kind by itself."""
    e = codec.encode(_numbered(spark, sf_dir))
    for i, (name, value) in enumerate((("z_code", 600), ("eaf_code", 300), ("se_code", 70), ("substitution", 15), ("exc_flags", 9)), 1):
        e = e.withColumn(name, F.when(F.col("row_id") % 1000 == i, value).otherwise(F.col(name)))
    return codec.bad_codes(e).select("row_id")


@query(O.sql("SELECT round(quantile_cont(log2(standard_error), 0.005e0), 9) AS low, round(quantile_cont(log2(standard_error), 0.995e0), 9) AS high FROM g WHERE standard_error > 0", _ONE))
def se_limits(spark, sf_dir):
    found = codec.residual_limits(view.study(spark, sf_dir))
    return found.select(r(F.col("limits")[0]).alias("low"), r(F.col("limits")[1]).alias("high"))


@query(O.sql("SELECT row_id, coalesce(base_pair_location - lag(base_pair_location) OVER (PARTITION BY chromosome, floor(row_id / 10000) ORDER BY row_id), 0) AS gap, base_pair_location AS restored_position FROM rows_", *O.RESOLVED, O.ROWS))
def chromosome_gaps(spark, sf_dir):
    """Steps within a chromosome's blocks, and the positions that they restore."""
    n, at = _numbered(spark, sf_dir), ("chromosome",)
    block = F.floor(F.col("row_id") / 10_000)
    starts = n.groupBy("chromosome", block.alias("b")).agg(F.min("base_pair_location").alias("first_position"))
    gaps = rowid.position_gaps(n, "base_pair_location", block=10_000, within=at).withColumn("b", block).join(starts, ["chromosome", "b"])
    return rowid.positions_from_gaps(gaps, block=10_000, within=at).select("row_id", "gap", "restored_position")


_FALLS = "CASE WHEN row_id % 700 = 0 AND row_id > 0 THEN 0 ELSE global_position END"


@query(O.sql(f"SELECT row_id FROM (SELECT row_id, p, lag(p) OVER (ORDER BY row_id) AS before FROM (SELECT row_id, {_FALLS} AS p FROM rows_)) WHERE p < before", *O.RESOLVED, O.ROWS))
def falling_positions(spark, sf_dir):
    """At the edges of blocks too, as every 700th row and blocks of 1,400 share some."""
    n = _numbered(spark, sf_dir).withColumn("global_position", F.expr(_FALLS))
    return rowid.falling_positions(n, block=1400).select("row_id")


# stores


_ROWS = "SELECT row_id, variant_code, round(z, 9) AS z, round(standard_error, 9) AS standard_error, round(effect_allele_frequency, 9) AS effect_allele_frequency FROM rows_"
_EXACT = ["row_id", "variant_code", "z", "standard_error", "effect_allele_frequency"]


@query(O.sql(_ROWS, *O.RESOLVED, O.ROWS))
def compress_study(spark, sf_dir):
    """From the raw study to a store, with QC, and back after opening it by its path."""
    made = api.compress(spark, view.study(spark, sf_dir), scratch.new_path(spark, "study"), profile="exact")
    return _shown(api.open_store(spark, made.path).read(columns=_EXACT, ordered=False), 9)


@query(O.sql(_ROWS, *O.RESOLVED, O.ROWS))
def compress_trusted(spark, sf_dir):
    """Without QC only rows that can't have an identity go: accepted rows, beside all that fail that test, come back alone."""
    g, keep = view.study(spark, sf_dir), ["ordinal", *_IDENTITY, "effect_allele", "other_allele", "beta", "standard_error", "effect_allele_frequency", "p_value"]
    unsafe = F.lit(False)
    for mask in qc.identity_safety(g).values():
        unsafe = unsafe | F.coalesce(mask, F.lit(False))
    rows = view.prepared(spark, sf_dir).select(*keep).union(g.where(unsafe).select(*keep))
    made = api.compress(spark, rows, scratch.new_path(spark, "trusted"), qc_mode="none", profile="exact")
    return _shown(made.read(columns=_EXACT, ordered=False), 9)


@query(O.sql(f"SELECT {_ID}, round(z, 9) AS z FROM k WHERE {O.IN_PANEL}", *O.BASE, O.PANEL))
def compress_named_panel(spark, sf_dir):
    """A panel by name with a pinned digest, found where the environment says."""
    path = scratch.new_path(spark, "core")
    panel.write_panel(view.panel(spark, sf_dir).join(view.prepared(spark, sf_dir).select("variant_code", *_IDENTITY), "variant_code"), path)
    request = f"common@sha256:{panel.verify_pin(spark, path, None)}"
    made = api.compress(spark, view.study(spark, sf_dir), scratch.new_path(spark, "by_name"), profile="exact", selection="core", panel=request, environ={"LOCUSFORGE_CORE_PANEL": path})
    return _shown(made.read(columns=[*_IDENTITY, "z"], ordered=False), 9)


@query(O.sql("SELECT row_id, ordinal, round(p_value, 9) AS p_supplied FROM rows_", *O.RESOLVED, O.ROWS))
def store_extras(spark, sf_dir):
    """Columns beside the core ones are stored as they are."""
    k = view.prepared(spark, sf_dir).withColumn("p_supplied", F.col("p_value"))
    made = store.write_store(k, scratch.new_path(spark, "extras"), extras=("ordinal", "p_supplied"))
    return made.read(columns=["row_id", "ordinal", "p_supplied"], ordered=False).withColumn("p_supplied", r("p_supplied"))


def _by_regions(spark: SparkSession, sf_dir: str) -> store.Store:
    return _store(spark, sf_dir, "regions", selection="pvalue_regions", padding=50_000)


@query(O.sql("SELECT chromosome, region_start, region_end, seed_snps FROM r", *O.RESOLVED, O.regions("1e-5", 50_000)))
def store_regions(spark, sf_dir):
    """The windows beside a store, read after opening it."""
    found = store.open_store(spark, _by_regions(spark, sf_dir).path).regions()
    return found.select("chromosome", F.col("start").alias("region_start"), F.col("end").alias("region_end"), "seed_snps")


@query(O.sql(f"SELECT row_number() OVER (ORDER BY {O.off('chromosome')} + region_start) AS rank, chromosome, region_start FROM r", *O.RESOLVED, O.regions("1e-5", 50_000)))
def regions_in_order(spark, sf_dir):
    found = select.ordered_regions(_by_regions(spark, sf_dir).regions())
    return found.select("rank", "chromosome", F.col("start").alias("region_start"))


_READ9 = "chromosome, base_pair_location, reference_allele, alternate_allele, round(dz, 6) AS z, round(dse, 6) AS standard_error, round(deaf, 6) AS effect_allele_frequency, round(dbeta, 6) AS beta"


@query(O.sql(f"SELECT {_READ9} FROM d WHERE chromosome IN ('2', 'X') AND base_pair_location BETWEEN 1000 AND 1500000", *O.DECODED))
def open_store_read(spark, sf_dir):
    opened = store.open_store(spark, _store(spark, sf_dir).path)
    return _shown(store.read_batch({"a": opened}, region="chr2:1000-1500000", columns=_COLS).union(store.read_batch({"a": opened}, region=("23", 1000, 1_500_000), columns=_COLS)).drop("study"))


# panels


_PANEL = f"panel0 AS (SELECT {_ID}, ordinal, ordinal % 160 = 0 AS hm3, variant_code FROM k WHERE ordinal % 40 = 0)"


def _panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.prepared(spark, sf_dir).where("ordinal % 40 = 0").select("ordinal", *_IDENTITY, (F.col("ordinal") % 160 == 0).alias("hm3"), "variant_code")


@query(O.sql("SELECT variant_code, chromosome, base_pair_location FROM panel0", *O.BASE, _PANEL))
def panel_bim(spark, sf_dir):
    rows = _panel_rows(spark, sf_dir)
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chromosome")), F.concat(F.lit("rs"), F.col("ordinal").cast("string")), F.lit("0"), F.col("base_pair_location").cast("string"), "alternate_allele", "reference_allele")
    path = f"{scratch.new_path(spark, 'plink')}/panel.bim"
    blocks.write_lines(rows.select(line.alias("value")), [], path)
    return panel.read_any(spark, path).select("variant_code", "chromosome", "base_pair_location")


@query(O.sql("SELECT variant_code, hm3 FROM panel0 WHERE chromosome IN ('1', '7', 'X')", *O.BASE, _PANEL))
def panel_shards(spark, sf_dir):
    """One file a chromosome, of which only those asked for are read."""
    folder, rows = scratch.new_path(spark, "shards"), _panel_rows(spark, sf_dir)
    for c in ("1", "2", "7", "X"):
        line = F.concat_ws("\t", "chromosome", F.col("base_pair_location").cast("string"), "reference_allele", "alternate_allele", F.col("hm3").cast("int").cast("string"))
        blocks.write_lines(rows.where(F.col("chromosome") == c).select(line.alias("value")), ["chromosome\tpos\tref\talt\thm3"], f"{folder}/by_chrom/chr{c}.tsv")
    return panel.read_any(spark, folder, chromosomes=["1", "7", "X"]).select("variant_code", "hm3")


@query(O.sql("SELECT variant_code, chromosome, base_pair_location FROM rows_", *O.RESOLVED, O.ROWS))
def panel_from_store(spark, sf_dir):
    return panel.read_any(spark, _store(spark, sf_dir).path).select("variant_code", "chromosome", "base_pair_location")


@query(O.sql("SELECT variant_code FROM panel0", *O.BASE, _PANEL))
def panel_of_ids(spark, sf_dir):
    """A file of one column, the keys."""
    key = identity.variant_key(*(F.col(c) for c in _IDENTITY))
    rows = _panel_rows(spark, sf_dir).select("ordinal", F.concat(F.lit("chr"), key).alias("value"))
    return panel.read_any(spark, _file(spark, rows, ["variant_id"], "ids", "gzip")).select("variant_code")


def _written(spark: SparkSession, sf_dir: str) -> panel.Panel:
    path = scratch.new_path(spark, "panel")
    panel.write_panel(_panel_rows(spark, sf_dir), path)
    return panel.open_panel(spark, path)


_NUMBERED = "nu AS (SELECT *, row_number() OVER (ORDER BY variant_code) AS row_ FROM panel0)"


@query(O.sql(f"SELECT 'chromosomes' AS how, variant_code, hm3 FROM nu WHERE chromosome IN ('3', '5') UNION ALL SELECT 'rows', variant_code, hm3 FROM nu WHERE row_ IN (1, 2, 50) UNION ALL SELECT 'keys', variant_code, hm3 FROM nu WHERE row_ <= 20 UNION ALL SELECT 'hm3', variant_code, hm3 FROM nu WHERE hm3", *O.BASE, _PANEL, _NUMBERED))
def panel_reads(spark, sf_dir):
    """A stored panel by chromosome, row (from one), key and flag."""
    p = _written(spark, sf_dir)
    keys = [x.variant_id for x in p.read(rows=range(1, 21)).collect()]  # the twenty that are asked for
    parts = {"chromosomes": p.read(chromosomes=["3", "5"]), "rows": p.read(rows=[1, 2, 50]), "keys": p.read(keys=keys), "hm3": p.read(hm3_only=True)}
    out = None
    for how, part in parts.items():
        part = part.select(F.lit(how).alias("how"), "variant_code", "hm3")
        out = part if out is None else out.union(part)
    return out


@query(O.sql("SELECT true AS valid, count(*) AS n_rows, count(*) FILTER (hm3) AS n_hm3 FROM panel0", *O.BASE, _PANEL))
def panel_validate(spark, sf_dir):
    found = _written(spark, sf_dir).validate()
    return spark.createDataFrame([(found["valid"], found["n_rows"], found["n_hm3"])], "valid boolean, n_rows long, n_hm3 long")


@query(O.sql("SELECT variant_code, bool_or(hm3) AS hm3 FROM (SELECT variant_code, false AS hm3 FROM k WHERE ordinal % 20 = 0 UNION ALL SELECT variant_code, true FROM k WHERE ordinal % 30 = 0) GROUP BY 1", *O.BASE))
def panel_merged(spark, sf_dir):
    """Two panels as one, a flag wherever either has it."""
    k = view.prepared(spark, sf_dir)
    two = k.where("ordinal % 20 = 0").select(*_IDENTITY, F.lit(False).alias("hm3")).union(k.where("ordinal % 30 = 0").select(*_IDENTITY, F.lit(True)))
    return panel.canonical(two).select("variant_code", "hm3")


@query(O.sql("SELECT variant_code FROM k WHERE ordinal % 40 IN (0, 1, 2)", *O.BASE))
def panel_identity_rules(spark, sf_dir):
    """Coordinates where they are given, else the id; an id that isn't a key says nothing; rows with neither go."""
    k = view.prepared(spark, sf_dir).withColumn("kind", F.col("ordinal") % 40).where("kind < 4")
    key = identity.variant_key(*(F.col(c) for c in _IDENTITY))
    ids = F.when(F.col("kind") == 0, key).when(F.col("kind") == 1, "rs1").when(F.col("kind") == 2, key)
    lacks = F.col("kind") >= 2
    cut = {c: F.when(~lacks, F.col(c)) for c in _IDENTITY}
    return panel.canonical(k.withColumn("variant_id", ids).withColumns(cut).select("variant_id", *_IDENTITY)).select("variant_code")


# references

_NEXT = "translate(alternate_allele, 'ACGT', 'CGTA')"
_RAW = f"SELECT {_ID}, alternate_allele || CASE WHEN ordinal % 3 = 0 THEN ',' || {_NEXT} ELSE '' END AS alts, 'rs' || (ordinal % 5000) || CASE WHEN ordinal % 4 = 0 THEN ';rs' || (ordinal % 77) ELSE '' END AS rsid, effect_allele_frequency FROM"
_AGAIN = f"SELECT {_ID}, alternate_allele AS alts, 'rs' || (ordinal % 99) || ';' AS rsid, effect_allele_frequency FROM"
_DICTIONARY = (
    *O.BASE,
    f"raw AS ({_RAW} k UNION ALL {_AGAIN} k WHERE ordinal % 10 = 0)",
    "split AS (SELECT chromosome, base_pair_location, reference_allele, unnest(string_split(alts, ',')) AS alternate_allele, rsid, effect_allele_frequency FROM raw)",
    f"dic AS (SELECT {_ID}, array_to_string(list_sort(list_distinct([x FOR x IN flatten(list(string_split(rsid, ';'))) IF x <> ''])), ';') AS rsids, min(effect_allele_frequency) AS ref_eaf FROM split WHERE reference_allele <> alternate_allele GROUP BY {_ID})",
    f"ix AS (SELECT *, row_number() OVER (ORDER BY {O.off('chromosome')} + base_pair_location, reference_allele, alternate_allele) - 1 AS idx FROM dic)",
)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = view.prepared(spark, sf_dir)
    rows = spark.sql(f"{_RAW} {{k}} UNION ALL {_AGAIN} {{k}} WHERE ordinal % 10 = 0", k=k)
    return rows.drop("alternate_allele").withColumnRenamed("alts", "alternate_allele")


def _stored(spark: SparkSession, sf_dir: str) -> reference.Reference:
    key = (spark.sparkContext.applicationId, sf_dir, view.stamp(spark, sf_dir))
    if key not in _REFERENCES:
        _REFERENCES[key] = reference.write_reference(_raw(spark, sf_dir), scratch.new_path(spark, "reference")).path
    return reference.open_reference(spark, _REFERENCES[key])


_REFERENCES: dict[tuple[str, str, str], str] = {}


@query(O.sql(f"SELECT {_ID}, rsids, round(ref_eaf, 9) AS ref_eaf FROM dic", *_DICTIONARY))
def reference_merged(spark, sf_dir):
    """Alternates apart, and the names of a variant together."""
    return harmonise.canonical_reference(_raw(spark, sf_dir)).select(*_IDENTITY, "rsids", r("ref_eaf").alias("ref_eaf"))


@query(O.sql(f"SELECT idx, {_ID} FROM ix", *_DICTIONARY))
def reference_index(spark, sf_dir):
    return _stored(spark, sf_dir).table().select("idx", *_IDENTITY)


@query(O.sql("SELECT true AS valid, count(*) AS n_rows FROM dic", *_DICTIONARY))
def reference_validate(spark, sf_dir):
    found = _stored(spark, sf_dir).validate()
    return spark.createDataFrame([(found["valid"], found["n_rows"])], "valid boolean, n_rows long")


@query(O.sql(f"SELECT 'region' AS how, idx FROM ix WHERE chromosome = '4' AND base_pair_location BETWEEN 1000 AND 900000 UNION ALL SELECT 'rsids', idx FROM ix WHERE list_has_any(string_split(rsids, ';'), ['rs7', 'rs4000', 'rs12']) UNION ALL SELECT 'rows', idx FROM ix WHERE idx BETWEEN 100 AND 400 UNION ALL SELECT 'keys', idx FROM ix WHERE idx IN (3, 500, 700) UNION ALL SELECT 'both', idx FROM ix WHERE chromosome = '4' AND list_has_any(string_split(rsids, ';'), ['rs7', 'rs12'])", *_DICTIONARY))
def reference_lookup(spark, sf_dir):
    """By region, name (through their index), row and key."""
    ref = _stored(spark, sf_dir)
    keys = [":".join(map(str, x[:4])) for x in ref.table().where("idx in (3, 500, 700)").collect()]
    parts = {"region": ref.query(("4", 1000, 900_000)), "rsids": ref.query(rsids=["rs7", "RS4000", "rs12"]), "rows": ref.query(rows=(100, 400)), "keys": ref.query(keys=keys), "both": ref.query(("4", 1, 1 << 30), rsids=["rs7", "rs12"])}
    out = None
    for how, part in parts.items():
        part = part.select(F.lit(how).alias("how"), "idx")
        out = part if out is None else out.union(part)
    return out
