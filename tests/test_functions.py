import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from locusforge.functions import builds, identity, stats


def test_builds():
    assert builds.normalize_build("hg-19") == "GRCh37" and builds.normalize_build("GRCH38") == "GRCh38"
    with pytest.raises(ValueError):
        builds.normalize_build("hg17")
    for b in builds.LENGTHS:
        off, size = builds.offsets(b), builds.lengths(b)
        assert off["1"] == 0 and off["2"] == size["1"] and len(off) == 24 and off["Y"] + size["Y"] == sum(size.values())


@pytest.mark.parametrize("build", ["GRCh37", "GRCh38"])
def test_identity_at_the_ends_of_chromosomes(spark, build):
    size = builds.lengths(build)
    rows = [(c, p, "A", "G") for c in size for p in (1, size[c])] + [("1", size["1"] + 1, "A", "G"), ("1", 0, "A", "G"), ("MT", 5, "A", "G"), ("1", 5, "AT", "G"), ("1", 5, "A", "A")]
    df = spark.createDataFrame(rows, "c string, p long, r string, a string")
    code = identity.variant_code(*(F.col(x) for x in "cpra"), build)
    place, sub = (F.col("code") / 16).cast("long"), F.col("code").bitwiseAND(15)
    (c, p), (r, a) = identity.decode_position(place, build), identity.decode_alleles(sub)
    out = df.withColumn("code", code).withColumns({"dc": c, "dp": p, "dr": r, "da": a}).collect()
    for row in out[:48]:
        assert (row.dc, row.dp, row.dr, row.da) == (row.c, row.p, row.r, row.a)
    assert all(row.code is None for row in out[48:])
    codes = [row.code for row in out[:48]]
    assert codes == sorted(codes)


def test_chromosome_names_and_keys(spark):
    names = {"chr1": "1", "CHR23": "X", "24": "Y", "m": "MT", "26": "MT", "": None, ".": None, "chrX ": "X", "GL1": "GL1"}
    df = spark.createDataFrame([(k,) for k in names], "k string")
    assert {r.k: r.v for r in df.select("k", identity.normalize_chromosome(F.col("k")).alias("v")).collect()} == names
    keys = spark.createDataFrame([("chr1:5:a:g",), ("1:5:A",), ("MT:5:A:G",), (None,)], "k string")
    got = [r.v for r in keys.select(identity.parse_key(F.col("k")).alias("v")).collect()]
    assert tuple(got[0]) == ("1", 5, "A", "G") and got[1:] == [None, None, None]
    comp = spark.createDataFrame([("ACN",)], "k string").select(identity.reverse_complement(F.col("k")), identity.is_palindromic(F.lit("A"), F.lit("T")), identity.variant_type(F.lit("AC"), F.lit("GT"))).first()
    assert tuple(comp) == ("NGT", True, "MNV")


def test_two_sided_p_against_erfc(spark):
    zs = [i / 50 for i in range(0, 1870)] + [-1.5, 1e-9]
    df = spark.createDataFrame([(float(z),) for z in zs], "z double")
    for r in df.select("z", stats.two_sided_p("z").alias("p")).collect():
        want = math.erfc(abs(r.z) / math.sqrt(2))
        assert abs(r.p - want) <= 4e-13 * want + 1e-300, r.z
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "z double")
    assert [r[0] for r in odd.select(stats.two_sided_p("z")).collect()] == [None] * 3


def test_se_from_p_against_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 1e-3, 0.0455, 0.3, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(0.2, p) for p in ps] + [(0.0, 0.5), (1.0, 1.0), (1.0, 0.0), (None, 0.5)], "b double, p double")
    got = [r[0] for r in df.select(stats.se_from_p("b", "p")).collect()]
    for p, v in zip(ps, got, strict=False):
        want = 0.2 / abs(NormalDist().inv_cdf(p / 2)) if p > 1e-290 else v
        assert abs(v / want - 1) < 1e-7
    assert got[len(ps) :] == [None] * 4


def test_number_parsing(spark):
    texts = {"1.5": 1.5, " 2 ": 2.0, "1e-3": 1e-3, "1d": None, "1f": None, "NA": None, ".": None, "": None, "Inf": math.inf, "-infinity": -math.inf, ".5": 0.5, "abc": None, "NaN": None}
    df = spark.createDataFrame([(k,) for k in texts], "k string")
    rows = df.select("k", stats.parse_number(F.col("k")).alias("v"), stats.failed_number(F.col("k")).alias("bad")).collect()
    assert {r.k: r.v for r in rows} == texts
    assert {r.k for r in rows if r.bad} == {"1d", "1f", "abc"}
