import pytest

from locusforge.operators import qc, select
from tests import fixtures as fx


def study(spark, positions, z, p=None):
    p = p or [None] * len(positions)
    data = [[i, "1", at, "A", "G", "G", "A", v * 0.1 if v is not None else None, 0.1, 0.2, q, None, None, None, v] for i, (at, v, q) in enumerate(zip(positions, z, p, strict=True))]
    return qc.canonicalize(fx.frame(spark, data))


def kept(df):
    return [r.ordinal for r in df.orderBy("ordinal").collect()]


def test_window_ends_are_inside_and_panel_rows_join(spark):
    df = study(spark, [89999, 90000, 100000, 110000, 110001, 300000], [0.0, 0.0, 4.5, 0.0, 0.0, 0.0])
    panel = spark.createDataFrame([("1:300000:A:G",)], "variant_id string")
    out, regions = select.select_variants(df, "core_plus", panel)
    assert kept(out) == [1, 2, 3, 5]
    assert [tuple(r) for r in regions.select("chromosome", "start", "end", "seed_snps").collect()] == [("1", 90000, 110000, 1)]


def test_windows_merge_where_they_touch(spark):
    df = study(spark, [100000, 115000, 135001, 155003], [5.0] * 4)
    got = select.pvalue_regions(df, 1e-5, 10_000).orderBy("start").collect()
    assert [(r.start, r.end, r.seed_snps) for r in got] == [(90000, 145001, 3), (145003, 165003, 1)]
    near = select.pvalue_regions(study(spark, [100000, 120001], [5.0, 5.0]), 1e-5, 10_000).collect()
    assert [(r.start, r.end) for r in near] == [(90000, 130001)]


def test_regions_wider_than_a_bin(spark):
    df = study(spark, [1, 3_000_000, 6_000_000, 9_000_001], [0.0, 5.0, 0.0, 0.0])
    out, _ = select.select_variants(df, "pvalue_regions", padding=6_000_000)
    assert kept(out) == [0, 1, 2]


def test_p_precedence_and_counters(spark):
    df = study(spark, [10, 20, 30, 40], [5.0, 0.0, 5.0, None], [0.5, 1e-8, -1.0, None])
    assert kept(select.seeds(df, 1e-5)) == [1, 2]
    got = select.p_provenance(df, 1e-5).first().asDict()
    assert got == {"n_rows": 4, "supplied": 2, "derived": 1, "missing": 1, "invalid": 1, "unresolved": 1, "hits": 2}


def test_panels_by_code_id_and_flag(spark):
    df = study(spark, [10, 20, 30], [0.0] * 3)
    panel = spark.createDataFrame([("chr1:10:a:g", 1), ("1:20:A:G", 0), ("1:30:A:C", 1), ("1:10:A:G", 1)], "variant_id string, hm3 int")
    assert kept(select.select_variants(df, "core", panel)[0]) == [0, 1]
    assert kept(select.select_variants(df, "hm3", panel)[0]) == [0]
    assert kept(select.in_panel(df, panel, how="left_anti")) == [2]
    ids = df.withColumn("variant_id", df.base_pair_location.cast("string"))
    assert kept(select.id_membership(ids, panel)) == [0, 1]


def test_shuffled_joins_agree_with_broadcast_ones(spark, monkeypatch):
    df = study(spark, [10, 20, 30], [0.0, 5.0, 0.0])
    panel = spark.createDataFrame([("1:10:A:G",)], "variant_id string")
    few = kept(select.select_variants(df, "core_plus", panel, padding=5)[0])
    monkeypatch.setattr(select, "BROADCAST_ROWS", 0)
    assert kept(select.select_variants(df, "core_plus", panel, padding=5)[0]) == few == [0, 1]


def test_arguments(spark):
    df = study(spark, [10], [0.0])
    for bad in ({"threshold": 0}, {"threshold": 1.5}, {"padding": -1}):
        with pytest.raises(ValueError):
            select.select_variants(df, "pvalue_regions", **bad)
    with pytest.raises(ValueError):
        select.select_variants(df, "core")
    with pytest.raises(ValueError):
        select.select_variants(df, "other")
