"""Variant identity: chromosome names, exact integer codes, text keys. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import builds

BASES = "ACGT"
KEY_PATTERN = r"^(?i)(?:[1-9]|1[0-9]|2[0-2]|X|Y):[0-9]+:[ACGT]:[ACGT]$"


def by_name(column: Column, values: dict[str, object]) -> Column:
    """The value that goes with a chromosome name, null for other names: a constant map, looked up in generated code."""
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.try_element_at(pairs, column)


def without_chr(name: Column) -> Column:
    """Without a chr prefix in any case; no regular expression, as this runs for every row."""
    return F.when(F.lower(F.substring(name, 1, 3)) == "chr", F.substring(name, 4, 1_000_000)).otherwise(name)


def normalize_chromosome(name: Column) -> Column:
    """Without a chr prefix, trimmed, upper case; 23, 24, M, 25 and 26 are X, Y and MT; blanks are null."""
    bare = F.upper(F.trim(without_chr(name)))
    mapped = F.when(bare == "23", "X").when(bare == "24", "Y").when(bare.isin("M", "25", "26"), "MT").otherwise(bare)
    return F.when(bare.isin("", ".", "NA"), F.lit(None)).otherwise(mapped)


def is_primary(name: Column) -> Column:
    return F.coalesce(name.isin(builds.CHROMOSOMES), F.lit(False))


def base_code(allele: Column) -> Column:
    """A, C, G, T as 0 to 3; null for anything else."""
    return F.when(allele.isin(*BASES), F.instr(F.lit(BASES), allele) - 1)


def global_position(chromosome: Column, position: Column, build: str = "GRCh38") -> Column:
    """Zero-based place in the concatenated assembly; null out of the chromosome's bounds."""
    inside = (position >= 1) & (position <= by_name(chromosome, builds.lengths(build)))
    return F.when(inside, by_name(chromosome, builds.offsets(build)) + position.cast("bigint") - 1)


def substitution(reference: Column, alternate: Column) -> Column:
    """4 times the reference's code plus the alternate's; null where they are equal or not bases."""
    return F.when(reference != alternate, 4 * base_code(reference) + base_code(alternate))


def variant_code(chromosome: Column, position: Column, reference: Column, alternate: Column, build: str = "GRCh38") -> Column:
    """global_position * 16 + substitution: one bigint for each variant, in genome order."""
    return global_position(chromosome, position, build) * 16 + substitution(reference, alternate).cast("bigint")


def decode_position(place: Column, build: str = "GRCh38") -> tuple[Column, Column]:
    """(chromosome, one-based position) of a global position; null beyond the genome."""
    starts, sizes = builds.offsets(build), builds.lengths(build)
    total = sum(sizes.values())
    chromosome = F.when((place < 0) | (place >= total), F.lit(None))
    before = F.lit(0).cast("bigint")
    for name in reversed(builds.CHROMOSOMES):
        chromosome = chromosome.when(place >= starts[name], name)
    for name in builds.CHROMOSOMES[1:]:
        before = F.when(place >= starts[name], F.lit(starts[name]).cast("bigint")).otherwise(before)
    return chromosome, F.when((place >= 0) & (place < total), place - before + 1)


def decode_alleles(code: Column) -> tuple[Column, Column]:
    """(reference, alternate) of a substitution from 0 to 15."""
    base = lambda x: F.substring(F.lit(BASES), x.cast("int") + 1, F.lit(1))
    return base(F.shiftright(code, 2)), base(code.bitwiseAND(3))


def variant_key(chromosome: Column, position: Column, reference: Column, alternate: Column) -> Column:
    """chromosome:position:REF:ALT, null where a part is."""
    return F.concat(chromosome, F.lit(":"), position.cast("bigint").cast("string"), F.lit(":"), F.upper(reference), F.lit(":"), F.upper(alternate))


def normalize_key(key: Column) -> Column:
    return F.upper(without_chr(F.trim(key)))


def parse_key(key: Column) -> Column:
    """chromosome, position, reference, alternate of a canonical key; null for others."""
    parts = F.split(normalize_key(key), ":")
    return F.when(normalize_key(key).rlike(KEY_PATTERN), F.struct(parts[0].alias("chromosome"), parts[1].try_cast("bigint").alias("position"), parts[2].alias("reference"), parts[3].alias("alternate")))


def complement(allele: Column) -> Column:
    return F.translate(allele, "ACGTN", "TGCAN")


def reverse_complement(allele: Column) -> Column:
    return F.reverse(complement(allele))


def is_palindromic(one: Column, two: Column) -> Column:
    return F.concat(one, two).isin("AT", "TA", "CG", "GC")


def variant_type(reference: Column, alternate: Column) -> Column:
    same = F.length(reference) == F.length(alternate)
    return F.when(same & (F.length(reference) == 1), "SNV").when(same, "MNV").otherwise("INDEL")
