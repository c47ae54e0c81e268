"""Alignment to a reference dictionary, lift-over between assemblies, and resolution of rsIDs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import builds, identity
from ..functions.session import tuned
from ..functions.stats import finite
from .select import BIN, sized

PATHS = ["direct", "reverse", "complement", "complement_reverse"]


def canonical_reference(df: DataFrame, snv_only: bool = False) -> DataFrame:
    """chromosome, position, reference, alternate, rsids, eaf, type: one row a variant, alternates split, ids merged."""
    split = df.select(identity.normalize_chromosome(F.col("chromosome")).alias("chromosome"), F.col("base_pair_location").cast("long").alias("base_pair_location"), F.upper("reference_allele").alias("reference_allele"), F.explode(F.split(F.upper("alternate_allele"), ",")).alias("alternate_allele"), (F.col("rsid") if "rsid" in df.columns else F.lit(None).cast("string")).alias("rsid"), (F.col("effect_allele_frequency") if "effect_allele_frequency" in df.columns else F.lit(None).cast("double")).alias("ref_eaf"))
    shape = "^[ACGT]$" if snv_only else "^[ACGTN]+$"
    good = split.where(F.col("reference_allele").rlike(shape) & F.col("alternate_allele").rlike(shape) & (F.col("reference_allele") != F.col("alternate_allele")))
    ids = F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.split("rsid", ";"))), lambda x: x != ""))), ";")
    keys = ["chromosome", "base_pair_location", "reference_allele", "alternate_allele"]
    return good.groupBy(*keys).agg(ids.alias("rsids"), F.min("ref_eaf").alias("ref_eaf")).withColumn("variant_type", identity.variant_type(F.col("reference_allele"), F.col("alternate_allele")))


def align(df: DataFrame, reference: DataFrame, strand: bool = True, palindromic: str = "drop", frequency_qc: str = "none", tolerance: float = 0.1) -> DataFrame:
    """Each row with status, path, flipped and frequency_status; effect statistics turned where alleles are.

    The alleles of the reference are gathered by place, so that a row meets them in one join, and its candidate pairs are
    looked up among them. A target that several rows reach makes all of them duplicates; they share its place, so that the
    join's partitioning serves that count as well. Rows without a place get one of their own there.
    """
    if palindromic not in ("drop", "allow", "frequency") or frequency_qc not in ("none", "report", "drop", "error"):
        raise ValueError("unknown policy")
    tuned(df)
    effect, other = F.upper("effect_allele"), F.upper("other_allele")
    place = {"_c": F.coalesce(identity.normalize_chromosome(F.col("chromosome")), F.concat(F.lit("row "), F.col("ordinal").cast("string"))), "_at": F.coalesce(F.col("base_pair_location").cast("long"), -1 - F.col("ordinal"))}
    alleles = {"_e": effect, "_o": other, "_re": identity.reverse_complement(effect), "_ro": identity.reverse_complement(other)}
    good = F.coalesce(effect.rlike("^[ACGTN]+$") & other.rlike("^[ACGTN]+$"), F.lit(False))
    asked = df.withColumns(place)
    gathered = reference.groupBy(F.col("chromosome").alias("_rc"), F.col("base_pair_location").cast("long").alias("_rat")).agg(F.collect_list(F.struct(F.col("reference_allele").alias("ref"), F.col("alternate_allele").alias("alt"), "ref_eaf", "rsids")).alias("_alleles"))
    met = asked.join(gathered, (F.col("_c") == F.col("_rc")) & (F.col("_at") == F.col("_rat")), "left").withColumns(alleles | {"_good": good})  # made behind the join, which sorts less so
    pairs = [("_o", "_e"), ("_e", "_o"), ("_ro", "_re"), ("_re", "_ro")][: 4 if strand else 2]

    def hit(rank: int, ref: str, alt: str) -> Column:
        same = F.filter("_alleles", lambda a: (a["ref"] == F.col(ref)) & (a["alt"] == F.col(alt)))
        return F.transform(same, lambda a: F.struct(F.lit(rank).alias("rank"), F.col("_rc").alias("r_chromosome"), F.col("_rat").alias("r_position"), a["ref"].alias("r_reference"), a["alt"].alias("r_alternate"), a["ref_eaf"].alias("r_eaf"), a["rsids"].alias("r_rsids")))

    found = F.concat(*(hit(i, ref, alt) for i, (ref, alt) in enumerate(pairs)))
    out = met.withColumn("hits", F.when(F.col("_good") & F.col("_alleles").isNotNull(), found))
    first = F.get("hits", F.lit(0))
    pick, clear = first, F.lit(False)
    pal, eaf = identity.is_palindromic(F.col("_e"), F.col("_o")), F.col("effect_allele_frequency")
    if palindromic == "allow":
        clear = pal
    elif palindromic == "frequency":
        near, far = F.abs(eaf - first["r_eaf"]), F.abs((1 - eaf) - first["r_eaf"])
        turned = F.get(F.filter("hits", lambda h: h["rank"].isin(1, 3)), F.lit(0))
        straight = F.get(F.filter("hits", lambda h: h["rank"].isin(0, 2)), F.lit(0))
        clear = pal & F.coalesce(near != far, F.lit(False))
        pick = F.when(clear & (far < near), F.coalesce(turned, first)).when(clear, F.coalesce(straight, first)).otherwise(first)
    out = out.withColumn("candidates", F.when(F.size("hits") > 0, F.size("hits").cast("long")))
    out = out.withColumn("ambiguous", F.coalesce((F.col("candidates") > 1) & ~clear, F.lit(False))).withColumn("hit", pick)
    status = F.when(F.col("ambiguous"), "ambiguous").when(~F.col("_good"), "incompatible").when(F.col("hit").isNull(), "unmatched").otherwise("aligned")
    out = out.withColumn("status", status).withColumn("_ref", F.col("hit.r_reference")).withColumn("_alt", F.col("hit.r_alternate"))
    copies = F.count("*").over(Window.partitionBy("_c", "_at", "_ref", "_alt", "status"))
    out = out.withColumn("_copies", copies).withColumn("status", F.when((F.col("status") == "aligned") & (F.col("_copies") > 1), "duplicate").otherwise(F.col("status")))
    aligned = F.col("status") == "aligned"
    flip = aligned & F.col("hit.rank").isin(1, 3)
    out = out.withColumn("flipped", F.coalesce(flip, F.lit(False))).withColumn("path", F.when(aligned, F.element_at(F.array(*map(F.lit, PATHS)), F.col("hit.rank") + 1)))
    turned_eaf = F.when(F.col("flipped"), 1 - F.col("effect_allele_frequency")).otherwise(F.col("effect_allele_frequency"))
    off = F.abs(turned_eaf - F.col("hit.r_eaf"))
    fstatus = F.when(F.lit(frequency_qc == "none") | ~aligned, "not_checked").when(~finite(turned_eaf), "missing_study").when(~finite(F.col("hit.r_eaf")), "missing_reference").when(off <= tolerance, "match").otherwise("mismatch")
    out = out.withColumn("frequency_status", fstatus)
    if frequency_qc == "drop":
        out = out.withColumn("status", F.when(F.col("frequency_status") == "mismatch", "frequency_mismatch").otherwise(F.col("status")))
    elif frequency_qc == "error":
        out = out.withColumn("status", F.when(F.col("frequency_status") == "mismatch", F.raise_error(F.lit("allele frequency doesn't match the reference")).cast("string")).otherwise(F.col("status")))
    turn = {"beta": lambda c: -c, "z": lambda c: -c, "effect_allele_frequency": lambda c: 1 - c, "odds_ratio": lambda c: F.when(c > 0, 1 / c).otherwise(c)}
    changed = {c: F.when(F.col("flipped"), f(F.col(c))).otherwise(F.col(c)) for c, f in turn.items() if c in df.columns}
    named = {"chromosome": "r_chromosome", "base_pair_location": "r_position", "reference_allele": "r_reference", "other_allele": "r_reference", "alternate_allele": "r_alternate", "effect_allele": "r_alternate"}
    changed |= {c: F.when(aligned, F.col(f"hit.{r}")).otherwise(F.col(c)) for c, r in named.items() if c in df.columns}
    changed["reference_rsids"] = F.when(aligned, F.col("hit.r_rsids"))
    return out.withColumns(changed).drop(*place, *alleles, "_good", "_rc", "_rat", "_alleles", "_ref", "_alt", "_copies", "hits", "hit", "ambiguous")


def status_counts(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("flipped").cast("long")).alias("flipped"))


def parse_chain(lines: DataFrame) -> DataFrame:
    """Chain text (line_no, value) to blocks: source chromosome and zero-based interval, target chromosome, start and strand.

    Blocks of a chain follow its head; running sums within the chain give their starts. A chain's lines lie together.
    """
    part = F.split(F.trim("value"), r"\s+")
    head = F.col("value").startswith("chain")
    chain = F.last(F.when(head, F.col("line_no")), True).over(Window.orderBy("line_no"))
    heads = lines.where(head).select(F.col("line_no").alias("chain"), part[2].alias("source"), part[5].cast("long").alias("s0"), part[7].alias("target"), part[8].cast("long").alias("t_size"), part[9].alias("strand"), part[10].cast("long").alias("t0"))
    blocks = lines.withColumn("chain", chain).where(~head & (F.trim("value") != "")).select("chain", "line_no", part[0].cast("long").alias("size"), F.coalesce(F.get(part, 1).cast("long"), F.lit(0)).alias("ds"), F.coalesce(F.get(part, 2).cast("long"), F.lit(0)).alias("dt"))
    before = Window.partitionBy("chain").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("s", F.coalesce(F.sum(F.col("size") + F.col("ds")).over(before), F.lit(0))).withColumn("t", F.coalesce(F.sum(F.col("size") + F.col("dt")).over(before), F.lit(0)))
    joined = placed.join(sized(heads), "chain")
    return joined.select(identity.normalize_chromosome(F.col("source")).alias("source"), (F.col("s0") + F.col("s")).alias("start"), (F.col("s0") + F.col("s") + F.col("size")).alias("end"), identity.normalize_chromosome(F.col("target")).alias("target"), (F.col("t0") + F.col("t")).alias("target_start"), "strand", "t_size")


def lift_over(df: DataFrame, blocks: DataFrame, to_build: str = "GRCh38") -> DataFrame:
    """Rows with lift_status; of mapped rows the place, and alleles on the other strand where the mapping is reversed.

    Blocks meet rows by chromosome and bin of the genome. A row keeps its place unless exactly one block covers it.
    """
    bins = F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))
    near = sized(blocks.where(F.col("end") > F.col("start")).withColumn("bin", F.explode(bins)))
    c, at = identity.normalize_chromosome(F.col("chromosome")), F.col("base_pair_location").cast("long") - 1
    keyed = df.select("ordinal", c.alias("c"), at.alias("p")).where("p >= 0")
    met = keyed.join(near, (F.col("c") == F.col("source")) & (F.floor(F.col("p") / BIN) == F.col("bin")) & (F.col("p") >= F.col("start")) & (F.col("p") < F.col("end")))
    step = F.col("target_start") + F.col("p") - F.col("start")
    place = F.when(F.col("strand") == "-", F.col("t_size") - 1 - step).otherwise(step) + 1
    found = met.groupBy("ordinal").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("target").alias("target"), place.alias("place"), F.col("strand").alias("strand"))).alias("_hit"))
    out = df.join(found, "ordinal", "left")
    inside = identity.is_primary(F.col("_hit.target")) & (F.col("_hit.place") >= 1) & (F.col("_hit.place") <= identity.by_name(F.col("_hit.target"), builds.lengths(to_build)))
    status = F.when(F.col("_n").isNull(), "unmapped").when(F.col("_n") > 1, "multi_mapped").when(~F.coalesce(inside, F.lit(False)), "non_primary_target").otherwise("mapped")
    out = out.withColumn("lift_status", status)
    mapped, minus = F.col("lift_status") == "mapped", F.col("_hit.strand") == "-"
    alleles = {a: F.when(mapped & minus, identity.reverse_complement(F.upper(a))).otherwise(F.col(a)) for a in ("reference_allele", "alternate_allele", "effect_allele", "other_allele") if a in df.columns}
    return out.withColumns({"chromosome": F.when(mapped, F.col("_hit.target")).otherwise(F.col("chromosome")), "base_pair_location": F.when(mapped, F.col("_hit.place")).otherwise(F.col("base_pair_location").cast("long")), **alleles}).drop("_n", "_hit")


def resolve_rsids(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Fills places of rows without coordinates whose rsID names exactly one variant of the reference; adds rsid_status."""
    names = reference.select(F.explode(F.split("rsids", ";")).alias("k"), F.struct("chromosome", "base_pair_location", "reference_allele", "alternate_allele").alias("v")).where("k <> ''")
    table = names.groupBy(F.lower("k").alias("k")).agg(F.count_distinct("v").alias("variants"), F.min("v").alias("v"))
    lacking = F.col("chromosome").isNull() | F.col("base_pair_location").isNull()
    asked = df.withColumn("_k", F.when(lacking & F.col("rsid").rlike("^(?i)rs"), F.lower("rsid"))).withColumn("base_pair_location", F.col("base_pair_location").cast("long"))
    rest = asked.where("_k is null").withColumn("rsid_status", F.when(lacking, "not_attempted").otherwise("coordinate")).drop("_k")
    # only rows that ask for a name move
    out = asked.where("_k is not null").join(table, F.col("_k") == F.col("k"), "left")
    out = out.withColumn("rsid_status", F.when(F.col("variants").isNull(), "unresolved").when(F.col("variants") > 1, "ambiguous").otherwise("resolved"))
    hit = F.col("rsid_status") == "resolved"
    out = out.withColumns({"chromosome": F.when(hit, F.col("v.chromosome")).otherwise(F.col("chromosome")), "base_pair_location": F.when(hit, F.col("v.base_pair_location")).otherwise(F.col("base_pair_location"))})
    return out.drop("_k", "k", "variants", "v").unionByName(rest)


def reference_query(reference: DataFrame, region: tuple[str, int, int] | None = None, rsids: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows of a dictionary by region, rsID or key. Regions and the places of keys reach the scan; rsIDs of a stored reference have an index (sources/reference.py)."""
    out = reference
    if region is not None:
        out = out.where((F.col("chromosome") == region[0]) & F.col("base_pair_location").between(region[1], region[2]))
    if rsids is not None:
        out = out.where(F.arrays_overlap(F.split("rsids", ";"), F.array(*map(F.lit, rsids))))
    if keys is not None:
        out = at_keys(out, keys)
    return out


def at_keys(reference: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is listed: chromosome and position narrow the scan, alleles decide."""
    parts = [k.split(":") for k in keys]
    if any(len(p) != 4 or not p[1].isdigit() for p in parts):
        raise ValueError("a key looks like 1:100:A:G")
    near = F.col("chromosome").isin(sorted({p[0] for p in parts})) & F.col("base_pair_location").isin(sorted({int(p[1]) for p in parts}))
    exact = identity.variant_key(F.col("chromosome"), F.col("base_pair_location"), F.col("reference_allele"), F.col("alternate_allele")).isin(keys)
    return reference.where(near & exact)
