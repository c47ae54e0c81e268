import bz2
import gzip
import lzma

import pytest
import zstandard

from locusforge import api
from locusforge.operators import resolve
from locusforge.sources import blocks, delimited
from tests import fixtures as fx

HEAD = ["CHR", "GENPOS", "REF", "ALT", "ALLELE1", "ALLELE0", "BETA", "SE", "A1FREQ"]


def text(sep="\t", n=12):
    rows = [[r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9]] for r in fx.rows(n)]
    return "\n".join([sep.join(HEAD), *(sep.join(map(str, r)) for r in rows)]) + "\n"


@pytest.mark.parametrize("sep", ["\t", ",", ";", "|", " "])
def test_separators(spark, tmp_path, sep):
    p = tmp_path / "s.txt"
    p.write_text("﻿" + text(sep))
    out = api.import_sumstats(spark, str(p)).data.orderBy("ordinal").collect()
    assert [r.base_pair_location for r in out] == [r[2] for r in fx.rows(12)]
    assert all(abs(r.z - w[14]) < 1e-12 for r, w in zip(out, fx.rows(12), strict=True))


@pytest.mark.parametrize("end, pack", [("gz", gzip.compress), ("bgz", lambda b: gzip.compress(b[:100]) + gzip.compress(b[100:])), ("bz2", bz2.compress), ("xz", lzma.compress), ("zst", zstandard.ZstdCompressor().compress)])
def test_transports(spark, tmp_path, end, pack):
    p = tmp_path / f"s.tsv.{end}"
    p.write_bytes(pack(text().encode()))
    assert api.import_sumstats(spark, str(p)).data.count() == 12


def test_malformed_rows_and_empty_inputs_raise(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text(text() + "1\t5\tA\n")
    with pytest.raises(Exception, match="malformed row"):
        api.import_sumstats(spark, str(p)).data.collect()
    p.write_text("\t".join(HEAD) + "\n")
    with pytest.raises(delimited.SourceError):
        api.import_sumstats(spark, str(p))
    with pytest.raises(delimited.SourceError):
        api.import_sumstats(spark, fx.study(spark, 1).limit(0))


def frame(spark, rows, columns):
    return spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"`{c}` string" for c in columns))


def test_routes(spark):
    r = resolve.resolve(frame(spark, [("1", 5, "C", "A", "A", "C", 1.2, 0.1)], ["CHR", "GENPOS", "REF", "ALT", "ALLELE1", "ALLELE0", "OR", "SE"]))
    got = r.data.first()
    assert abs(got.beta - 0.1823215567939546) < 1e-12 and abs(got.z - 1.823215567939546) < 1e-9 and "odds_ratio" in r.routes["beta"]
    p = resolve.resolve(frame(spark, [("1", 5, "C", "A", "A", "C", 0.2, "NA", 0.0455)], ["chr", "pos", "ref", "alt", "EA", "OA", "beta", "SE", "P"]), allow_p_to_se=True).data.first()
    assert abs(p.standard_error - 0.1) < 1e-4 and abs(p.z - 2.0) < 1e-3
    lp = resolve.resolve(frame(spark, [("1", 5, 0.1, 0.1, 3)], ["chr", "pos", "beta", "SE", "LP"])).data.first()
    assert abs(lp.p_value - 1e-3) < 1e-15


@pytest.mark.parametrize(
    "columns, row, message",
    [
        (["chr", "pos", "beta", "OR", "SE"], ("1", 5, 0.5, 1.2, 0.1), "odds_ratio are inconsistent"),
        (["chr", "pos", "beta", "SE", "Z"], ("1", 5, 0.5, 0.1, 9), "z is inconsistent"),
        (["chr", "CHROM", "pos", "beta", "SE"], ("1", "2", 5, 0.5, 0.1), "differ"),
    ],
)
def test_contradictions_always_raise(spark, columns, row, message):
    with pytest.raises(resolve.ResolutionError, match=message):
        resolve.resolve(frame(spark, [row], columns))


def test_policies_for_bad_numbers(spark):
    df = frame(spark, [("1", "5.5", "abc", 0.1), ("1", "7", "0.1", 0.1)], ["chr", "pos", "beta", "SE"])
    rows = resolve.resolve(df).data.orderBy("ordinal").collect()
    assert [(r.base_pair_location, r.beta, sorted(r.parse_failed)) for r in rows] == [(None, None, ["base_pair_location", "beta"]), (7, 0.1, [])]
    with pytest.raises(resolve.ResolutionError):
        resolve.resolve(df, "error")
    same = resolve.resolve(frame(spark, [("1", "1.0", 5, 0.5, 0.1)], ["beta", "effect", "pos", "SE", "af"]), check=False)
    assert "beta" in same.data.columns


def test_projection_and_ids(spark):
    df = frame(spark, [("1", 5, "A", "G", "x", "rs7")], ["chr", "pos", "oa", "ea", "unused", "SNP"])
    assert resolve.project(df).columns == ["chr", "pos", "oa", "ea", "SNP"]
    out = resolve.resolve(df).data.first()
    assert out.rsid == "rs7" and out.unused == "x"
    assert resolve.resolve(df.drop("SNP")).data.first().variant_id == "1_5_A_G"


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ttrait
1\t5\trs1\tA\tG\t.\tPASS\tAF=0.5;SE=9\tES:SE:LP\t0.1:0.2:3
1\t6\t.\tC\tT\t.\tPASS\tOR=2;SE=0.3;P=0.01\tAF\t0.4
"""


def test_vcf(spark, tmp_path):
    p = tmp_path / "x.vcf.gz"
    p.write_bytes(gzip.compress(VCF.encode()))
    a, b = api.import_sumstats(spark, str(p)).data.orderBy("ordinal").collect()
    assert (a.beta, a.standard_error, a.effect_allele_frequency, a.rsid) == (0.1, 0.2, 0.5, "rs1") and abs(a.p_value - 1e-3) < 1e-15
    assert abs(b.beta - 0.6931471805599453) < 1e-12 and (b.standard_error, b.p_value, b.effect_allele_frequency) == (0.3, 0.01, 0.4)
    p.write_bytes(gzip.compress(VCF.replace("\tG\t", "\tG,T\t").encode()))
    with pytest.raises(Exception, match="several ALT"):
        api.import_sumstats(spark, str(p)).data.collect()
    p.write_bytes(gzip.compress(VCF.replace("\ttrait", "\ta\tb").encode()))
    with pytest.raises(delimited.SourceError, match="one trait"):
        api.import_sumstats(spark, str(p))


def test_preflight_reports(spark):
    df = fx.study(spark, 20).drop("ordinal", "z")
    out = api.preflight(spark, df)
    assert out.report.accepted_rows == 20 and out.data.count() == 20


def test_a_program_of_the_users_decompresses(spark, tmp_path, monkeypatch):
    p = tmp_path / "x.tsv.gz"
    p.write_bytes(gzip.compress(b"chr\tpos\n1\t5\n2\t6\n"))
    monkeypatch.setenv("LOCUSFORGE_DECOMPRESSOR", "gzip")
    assert [tuple(r)[1:] for r in delimited.read_delimited(spark, str(p)).orderBy("ordinal").collect()] == [("1", "5"), ("2", "6")]
    monkeypatch.setenv("LOCUSFORGE_DECOMPRESSOR", "false")
    with pytest.raises(delimited.SourceError, match="ended with"):
        delimited.first_line(spark, str(p))


def test_headers_far_down_and_joined_files(spark, tmp_path):
    p = tmp_path / "far.tsv"
    p.write_text("".join(f"## {i}\n" for i in range(20_000)) + "chr\tpos\n1\t5\n")
    one = delimited.read_delimited(spark, str(p))
    assert one.count() == 1
    assert one.union(delimited.read_delimited(spark, str(p))).where("chr = 'chr'").count() == 0
    v = tmp_path / "far.vcf"
    v.write_text("##fileformat=VCFv4.2\n" + "".join(f"##x={i}\n" for i in range(20_000)) + "#CHROM\tPOS\tID\tREF\tALT\n1\t5\t.\tA\tG\n")
    assert delimited.read_vcf(spark, str(v)).count() == 1


@pytest.mark.parametrize("end, unpack", [("gz", gzip.decompress), ("bz2", bz2.decompress), ("none", bytes)])
def test_many_tasks_write_and_read_one_file(spark, tmp_path, monkeypatch, end, unpack):
    monkeypatch.setattr(blocks, "RANGE", 1 << 17)
    rows = spark.range(0, 20_000, 1, 3).selectExpr("concat(id, ' é ', sha2(string(id), 256)) value")
    p = tmp_path / f"x.txt.{end}"
    blocks.write_lines(rows, ["## a", "head"], str(p), end)
    want = unpack(p.read_bytes()).decode().split("\n")
    assert want[:2] == ["## a", "head"] and want[-1] == "" and sorted(want[2:-1]) == sorted(r.value for r in rows.collect())
    got = delimited.lines(spark, str(p))
    assert [r.value for r in got.orderBy("line_no").collect()] == want[:-1]
    assert end != "gz" or got.rdd.getNumPartitions() > 4
    if end == "gz":  # members that aren't blocks, and text without a last line's end
        q = tmp_path / "mixed.gz"
        q.write_bytes(p.read_bytes() + gzip.compress(b"more\r\nlast"))
        assert sorted(r.value for r in delimited.lines(spark, str(q)).collect()) == sorted([*want[:-1], "more", "last"])


def test_vcf_names_are_looked_up_and_clashes_raise(spark):
    names = ["#CHROM", "POS", "REF", "ALT", "INFO", "FORMAT", "trait"]
    read = lambda info, fmt, trait: delimited.vcf_fields(spark.createDataFrame([(1, "1", "5", "A", "G", info, fmt, trait)], "ordinal long, " + ", ".join(f"`{c}` string" for c in names)), names)
    got = read("a_f=x=y;FLAG;FLAG;SE=3;SE=3;=7", "ES:LP:SE", "1:2").first()
    assert (got.beta, got.standard_error, got.effect_allele_frequency, got.p_value) == ("1", "3", "x=y", "0.01")
    for bad in (("AF=1;a_f=2", "SE", "1"), (".", "ES:es", "1:2")):
        with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
            read(*bad).collect()
