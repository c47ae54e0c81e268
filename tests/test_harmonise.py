import pytest

from locusforge.operators import harmonise as H

REF = [("1", 10, "A", "G", "rs1", 0.3), ("1", 20, "C", "A", "rs2;rs9", 0.2), ("1", 30, "A", "T", "rs3", 0.1), ("2", 5, "G", "T", "rs9", 0.4)]


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame(REF, "chromosome string, base_pair_location long, reference_allele string, alternate_allele string, rsids string, ref_eaf double")


def study(spark, rows):
    return spark.createDataFrame([(i, *r, 0.5, 2.0) for i, r in enumerate(rows)], "ordinal long, chromosome string, base_pair_location long, other_allele string, effect_allele string, effect_allele_frequency double, beta double, z double")


def test_four_ways_to_align(spark, ref):
    rows = [("1", 10, "A", "G", 0.3), ("1", 20, "A", "C", 0.8), ("2", 5, "C", "A", 0.4), ("9", 1, "A", "G", 0.1), ("1", 10, "<X>", "G", 0.1), ("1", 30, "A", "T", 0.1)]
    got = {r.ordinal: r for r in H.align(study(spark, rows), ref).collect()}
    assert [got[i].status for i in range(6)] == ["aligned", "aligned", "aligned", "unmatched", "incompatible", "ambiguous"]
    assert [got[i].path for i in range(3)] == ["direct", "reverse", "complement"]
    assert (got[1].beta, got[1].z, round(got[1].effect_allele_frequency, 9), got[1].other_allele, got[1].effect_allele) == (-0.5, -2.0, 0.2, "C", "A")
    strict = {r.ordinal: r.status for r in H.align(study(spark, rows), ref, strand=False).collect()}
    assert strict[2] == "unmatched" and strict[5] == "aligned"


def test_palindromes_and_duplicates(spark, ref):
    rows = [("1", 30, "A", "T", 0.12), ("1", 30, "A", "T", 0.95), ("1", 30, "A", "T", 0.5)]
    by_frequency = [r for r in H.align(study(spark, rows[:1]), ref, palindromic="frequency").collect()]
    assert (by_frequency[0].status, by_frequency[0].flipped) == ("aligned", False)
    turned = H.align(study(spark, rows[1:2]), ref, palindromic="frequency").first()
    assert (turned.status, turned.flipped) == ("aligned", True)
    assert H.align(study(spark, rows[2:]), ref, palindromic="frequency").first().status == "ambiguous"
    assert H.align(study(spark, rows[:1]), ref, palindromic="allow").first().path == "direct"
    twice = H.align(study(spark, [("1", 10, "A", "G", 0.3), ("1", 10, "G", "A", 0.7)]), ref)
    assert [r.status for r in twice.collect()] == ["duplicate", "duplicate"]
    assert {r.status: r.n for r in H.status_counts(twice).collect()} == {"duplicate": 2}


def test_frequency_policies(spark, ref):
    rows = [("1", 10, "A", "G", 0.9)]
    assert H.align(study(spark, rows), ref, frequency_qc="report").first().frequency_status == "mismatch"
    assert H.align(study(spark, rows), ref, frequency_qc="drop").first().status == "frequency_mismatch"
    with pytest.raises(Exception, match="frequency"):
        H.align(study(spark, rows), ref, frequency_qc="error").collect()


def test_liftover(spark):
    chain = ["chain 1 chr1 1000 + 0 300 chr1 2000 + 100 400 1", "100 50 60", "150", "", "chain 1 chr2 1000 + 0 100 chr2 242193529 - 50 150 2", "100", ""]
    blocks = H.parse_chain(spark.createDataFrame(list(enumerate(chain)), "line_no long, value string"))
    assert sorted(map(tuple, blocks.collect())) == [("1", 0, 100, "1", 100, "+", 2000), ("1", 150, 300, "1", 260, "+", 2000), ("2", 0, 100, "2", 50, "-", 242193529)]
    rows = [("1", 1, "A", "G", 0.1), ("1", 120, "A", "G", 0.1), ("1", 151, "A", "G", 0.1), ("2", 1, "A", "G", 0.1)]
    got = H.lift_over(study(spark, rows), blocks).orderBy("ordinal").collect()
    assert [(r.lift_status, r.base_pair_location) for r in got] == [("mapped", 101), ("unmapped", 120), ("mapped", 261), ("mapped", 242193479)]
    assert (got[3].other_allele, got[3].effect_allele) == ("T", "C")


def test_rsids_resolve_only_if_unique(spark, ref):
    df = spark.createDataFrame([(0, None, None, "rs1"), (1, None, None, "RS9"), (2, None, None, "rs77"), (3, "1", 7, "rs1"), (4, None, None, "x")], "ordinal long, chromosome string, base_pair_location long, rsid string")
    got = {r.ordinal: (r.rsid_status, r.base_pair_location) for r in H.resolve_rsids(df, ref).collect()}
    assert got == {0: ("resolved", 10), 1: ("ambiguous", None), 2: ("unresolved", None), 3: ("coordinate", 7), 4: ("not_attempted", None)}


def test_reference_dictionary(spark, ref):
    raw = spark.createDataFrame([("chr1", 5, "A", "G,T", "rs1"), ("1", 5, "A", "G", "rs2;rs1"), ("1", 6, "A", "AT", None), ("1", 7, "A", "<D>", None)], "chromosome string, base_pair_location long, reference_allele string, alternate_allele string, rsid string")
    got = {(r.base_pair_location, r.alternate_allele): (r.rsids, r.variant_type) for r in H.canonical_reference(raw).collect()}
    assert got == {(5, "G"): ("rs1;rs2", "SNV"), (5, "T"): ("rs1", "SNV"), (6, "AT"): ("", "INDEL")}
    assert H.reference_query(ref, region=("1", 10, 20)).count() == 2
    assert H.reference_query(ref, rsids=["rs9"]).count() == 2 and H.reference_query(ref, keys=["2:5:G:T"]).count() == 1
