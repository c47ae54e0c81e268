import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from locusforge import api
from locusforge.operators import codec, qc
from locusforge.operators.rowid import position_gaps, positions_from_gaps, with_row_id
from locusforge.sources import panel, scratch, store
from locusforge.sources.files import StoreError
from tests import fixtures as fx


@pytest.fixture(scope="module")
def native(spark):
    return store.write_store(qc.canonicalize(fx.study(spark, 1200)), scratch.new_path(spark, "t"))


def test_full_read_is_close_and_in_order(spark, native):
    got = native.read(columns=["row_id", "base_pair_location", "z", "standard_error", "effect_allele_frequency", "beta", "p_value", "reference_allele"]).collect()
    want = fx.rows(1200)
    assert [r.row_id for r in got] == list(range(1200))
    for r, w in zip(got, want, strict=True):
        assert r.base_pair_location == w[2] and r.reference_allele == w[3]
        assert abs(r.effect_allele_frequency - w[9]) < 0.006 and abs(r.beta - w[7]) < 0.02 and abs(r.standard_error - w[8]) < 0.01
        assert abs(r.z - w[14]) <= 7 / 1020 + 1e-6
        assert abs(r.p_value - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-12


def test_regions_keys_rows_and_their_conjunction(spark, native):
    place = lambda **k: [r.base_pair_location for r in native.read(columns=["base_pair_location"], **k).collect()]
    assert place(region="chr1:100010-100012") == place(region=("1", 100010, 100012)) == place(region="1:100010-100012") == [100010, 100011, 100012]
    keys = ["chr1:100020:a:t", "1:100004:A:T", "1:100004:A:T", "1:999999:A:T"]
    assert place(variants=keys) == [100004, 100020]
    assert place(variants=[5, 0, 5]) == [100001, 100006]
    assert place(region="1:100004-100010", variants=keys) == [100004]
    assert place(region="2:1-1000") == []
    assert native.read(columns=["global_position", "substitution"], region="1:100001-100001").first() == (100000, 4)
    for bad in ({"variants": ["rs1"]}, {"variants": [1200]}, {"region": "x"}, {"columns": ["nope"]}):
        with pytest.raises(ValueError):
            native.read(**bad)


def test_region_reaches_the_scan(spark, native):
    plan = native.read("1:100010-100012", ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(base_pair_location" in plan and "chromosome" in plan.split("PartitionFilters")[1][:200]
    assert "exc_eaf" not in native.read(columns=["z"], ordered=False)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_flag_threshold_is_inclusive(spark):
    data = fx.rows(6)
    for row, p in zip(data, [1e-9, 5e-8, 5.0001e-8, 1e-3, None, float("nan")], strict=True):
        row[10], row[14], row[7] = p, 0.0, 0.0
    s = store.write_store(qc.canonicalize(fx.frame(spark, data)), scratch.new_path(spark, "flag"))
    assert sorted(r.row_id for r in s.pvalue_flag().collect()) == [0, 1]
    assert s.fetch_flagged(["base_pair_location"]).count() == 2
    off = store.write_store(qc.canonicalize(fx.frame(spark, data)), scratch.new_path(spark, "flag"), flag_threshold=None)
    with pytest.raises(StoreError):
        off.pvalue_flag()


def test_exceptions_are_exact(spark):
    data = fx.rows(200)
    data[0][7], data[0][8], data[0][9] = 1e5, 1000.0, None
    data[1][7], data[1][8], data[1][9] = -100.0, 1e-6, None
    for r in data[:2]:
        r[14] = r[7] / r[8]
    s = store.write_store(qc.canonicalize(fx.frame(spark, data)), scratch.new_path(spark, "exc"))
    got = s.read(columns=["z", "standard_error", "effect_allele_frequency", "beta"]).collect()
    for r, w in zip(got[:2], data[:2], strict=True):
        assert abs(r.z / w[14] - 1) < 1e-5 and abs(r.standard_error / w[8] - 1) < 1e-5 and r.effect_allele_frequency is None
    counts = codec.exception_counts(s.table()).first()
    assert counts.eaf_exceptions == 2 and counts.z_exceptions >= 2 and counts.se_exceptions >= 2


def test_z_at_the_upper_edge(spark):
    df = spark.createDataFrame([(3.5,), (-3.5,), (None,), (float("nan"),), (3.4999,)], "z double")
    native = [r[0] for r in df.select(codec.z_code(F.col("z"))).collect()]
    legacy = [r[0] for r in df.select(codec.z_code(F.col("z"), codec.LEGACY)).collect()]
    assert native == [511, 0, 510, 510, 509] and legacy[0] == 509


def test_validate_and_damage(spark, native, tmp_path):
    assert native.validate()["n_rows"] == 1200
    again = store.open_store(spark, native.path)
    assert again.read().count() == 1200
    s = store.write_store(qc.canonicalize(fx.study(spark, 50)), f"file://{tmp_path}/s")
    part = next((tmp_path / "s/values").rglob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    with pytest.raises(StoreError):
        s.validate()
    (tmp_path / "s/manifest.json").write_text("{}")
    with pytest.raises(StoreError):
        store.open_store(spark, s.path)


def test_order_of_blocks_is_checked_at_any_size(spark):
    class Large:
        """A table that says it has 200,000,001 rows."""

        def __init__(self, df):
            self.groupBy, self.n = df.groupBy, 200_000_001

        def agg(self, *_):
            return self

        def first(self):
            return SimpleNamespace(n=self.n, low=0, high=self.n - 1, ids=self.n, codes=self.n)

    class Held(store.Store):
        def table(self):
            return Large(self.held)

    for blocks, fits in (([(0, 1), (0, 5), (1, 6), (1, 8), (2, 9)], True), ([(0, 1), (0, 6), (1, 5), (1, 8)], False), ([(0, 1), (2, 5)], False)):
        held = Held(spark, "", {"n_rows": 200_000_001, "profile": "exact"})
        held.held = spark.createDataFrame(blocks, "block_id int, variant_code long")
        if fits:
            assert held.validate(full=False)["valid"]
        else:
            with pytest.raises(StoreError, match="overlap"):
                held.validate(full=False)


def test_overwrite_duplicates_and_empty(spark, native):
    df = qc.canonicalize(fx.study(spark, 20))
    with pytest.raises(StoreError, match="exists"):
        store.write_store(df, native.path)
    with pytest.raises(StoreError, match="more than once"):
        store.write_store(df.union(df), scratch.new_path(spark, "d"))
    with pytest.raises(StoreError, match="no rows"):
        store.write_store(df.limit(0), scratch.new_path(spark, "e"))
    path = scratch.new_path(spark, "o")
    store.write_store(df, path)
    assert store.write_store(df.limit(7), path, overwrite=True).read().count() == 7


def test_equal_runs_have_equal_digests(spark):
    df = qc.canonicalize(fx.study(spark, 300))
    a, b = (store.write_store(df, scratch.new_path(spark, "eq")).manifest["integrity"]["canonical_sha256"] for _ in range(2))
    assert a == b


def test_exact_profile_extras_cache_and_batch(spark, native):
    df = qc.canonicalize(fx.study(spark, 100))
    exact = store.write_store(df, scratch.new_path(spark, "x"), profile="exact", extras=("annotation",))
    got = exact.read(columns=["z", "annotation"]).collect()
    assert [(r.z, r.annotation) for r in got] == [(w[14], w[13]) for w in fx.rows(100)]
    cached = native.build_cache().collect()
    assert len(cached) == 1200 and all(abs(r.effect_allele_frequency - w[9]) < 0.01 for r, w in zip(cached, fx.rows(1200), strict=True))
    both = store.read_batch({"a": native, "b": exact}, ["1:100004:A:T"], columns=["z"]).collect()
    assert sorted(r.study for r in both) == ["a", "b"]


def test_row_ids_and_gaps_over_ranges(spark):
    df = spark.range(0, 3000, 1, 7).select(((F.col("id") * 7919) % 3001).alias("global_position"))
    out = with_row_id(df, ["global_position"])
    rows = [tuple(r) for r in out.orderBy("global_position").collect()]
    assert [r[1] for r in rows] == list(range(3000))
    gaps = position_gaps(out, block=100).withColumn("first_position", F.lit(0))
    assert gaps.where("row_id % 100 = 0 and gap <> 0").count() == 0
    starts = out.groupBy(F.floor(F.col("row_id") / 100).alias("b")).agg(F.min("global_position").alias("first_position"))
    back = positions_from_gaps(gaps.drop("first_position").withColumn("b", F.floor(F.col("row_id") / 100)).join(starts, "b"), block=100)
    assert back.where("restored_position <> global_position").count() == 0
    assert with_row_id(df.limit(0), ["global_position"]).count() == 0


def test_panels(spark, tmp_path):
    rows = [("2:100:G:A", 1), ("1:200:C:T", 0), ("1:100:A:G", 1), ("X:300:T:C", 0)]
    p = panel.write_panel(spark.createDataFrame(rows, "variant_id string, hm3 int"), scratch.new_path(spark, "p"))
    ids = lambda **k: [r.variant_id for r in p.read(**k).collect()]
    assert ids() == ["1:100:A:G", "1:200:C:T", "2:100:G:A", "X:300:T:C"]
    assert ids(rows=[1, 3]) == ["1:100:A:G", "2:100:G:A"] and ids(hm3_only=True) == ["1:100:A:G", "2:100:G:A"]
    assert ids(chromosomes=["X"]) == ["X:300:T:C"] and ids(keys=["chr1:200:c:t", "1:1:A:G"]) == ["1:200:C:T"]
    assert p.validate() == {"valid": True, "n_rows": 4, "n_hm3": 2}
    with pytest.raises(ValueError):
        p.read(rows=[0])
    shards = tmp_path / "shards"
    shards.mkdir()
    for c in ("1", "2", "7"):
        (shards / f"chr{c}.tsv").write_text(f"variant_id\n{c}:10:A:G\n{c}:20:C:T\n")
    assert panel.read_any(spark, str(shards), chromosomes=["1", "7"]).count() == 4
    (tmp_path / "x.bim").write_text("1 rs1 0 100 G A\n1\trs2\t0\t200\tT\tC\n")
    assert panel.read_any(spark, str(tmp_path / "x.bim")).count() == 2
    assert panel.read_any(spark, p.path).count() == 4
    with pytest.raises(Exception, match="contradicts"):
        panel.canonical(spark.createDataFrame([("1:5:A:G", "1", 6, "A", "G")], "variant_id string, chromosome string, base_pair_location long, reference_allele string, alternate_allele string")).collect()
    with pytest.raises(ValueError):
        panel.resolve_name("core@sha256:12", {})
    assert panel.resolve_name("tag", {"LOCUSFORGE_PANEL_DIR": "/p"}) == ("/p/core", None)
    with pytest.raises(FileNotFoundError):
        panel.resolve_name("hm3", {})


def test_compress_from_text_to_store(spark, tmp_path):
    lines = ["CHR\tGENPOS\tREF\tALT\tALLELE1\tALLELE0\tBETA\tSE\tA1FREQ"] + [f"{r[1]}\t{r[2]}\t{r[3]}\t{r[4]}\t{r[5]}\t{r[6]}\t{r[7]}\t{r[8]}\t{r[9]}" for r in fx.rows(40)]
    lines.append("1\t5\tAT\tG\tG\tAT\t0.1\t0.1\t0.5")
    path = tmp_path / "s.tsv"
    path.write_text("\n".join(lines) + "\n")
    s = api.compress(spark, str(path), scratch.new_path(spark, "c"))
    assert s.manifest["n_rows"] == 40 and s.manifest["qc"]["rejections"] == {"indel": 1, "invalid_allele": 1}
    with pytest.raises(qc.QcError):
        api.compress(spark, str(path), scratch.new_path(spark, "c"), strict=True)
    for bad in ({"qc_mode": "none", "strict": True}, {"strict": True, "row_policy": "report"}, {"input_build": "hg19"}):
        with pytest.raises(ValueError):
            api.compress(spark, str(path), scratch.new_path(spark, "c"), **bad)
    trusted = api.compress(spark, fx.study(spark, 30), scratch.new_path(spark, "n"), qc_mode="none")
    assert api.validate(trusted)["n_rows"] == 30
    assert api.variant_key("chr23", 5, "a", "g") == "X:5:A:G"


def test_compress_keeps_the_first_copy_by_the_ordinal_of_the_source(spark):
    data = fx.rows(4)
    late, early = list(data[0]), list(data[0])
    late[0], early[0], early[7], early[14] = 9, 0, data[0][7] + 0.5, None
    early[14] = early[7] / early[8]
    source = fx.frame(spark, [late, *data[1:], early])  # the first copy lies last
    made = api.compress(spark, source, scratch.new_path(spark, "copies"), profile="exact")
    got = {r.base_pair_location: r.z for r in made.read(columns=["base_pair_location", "z"]).collect()}
    assert len(got) == 4 and got[data[0][2]] == early[14]


def test_full_validation_keeps_no_set_of_values(spark, tmp_path):
    made = store.write_store(qc.canonicalize(fx.study(spark, 50)), f"{tmp_path}/s")
    table = made.table()
    assert tuple(made._followed(table)) == (50, 0, 49, 50, 50)
    assert made._followed(table.union(table.where("row_id = 7"))).ids == 50 and made._followed(table.union(table.where("row_id = 7"))).n == 51
    assert made._followed(table.where("row_id <> 7")).ids == 48
    swapped = table.withColumn("variant_code", F.when(F.col("row_id") == 7, 0).otherwise(F.col("variant_code")))
    assert made._followed(swapped).codes == 49


def test_rows_are_moved_once(spark, sf_dir):
    from locusforge.plans import view
    from locusforge.plans.queries import _encoded, _numbered

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(_numbered(spark, sf_dir)).replace("BroadcastExchange", "")
    assert "SortMergeJoin" not in plan(_encoded(spark, sf_dir)) and "BroadcastHashJoin" in plan(_encoded(spark, sf_dir))
    rows = fx.study(spark, 40)
    from locusforge.operators import select

    found = select.id_membership(qc.canonicalize(rows), rows.where("ordinal < 5").select("variant_id"))
    assert plan(found).count("Join ") == 1 and {r.ordinal for r in found.collect()} >= {1, 2, 3, 4}
    checked = plan(qc.with_reasons(view.with_z(view.study(spark, sf_dir))))
    assert checked.count("Sort [") == 1


def test_the_report_takes_one_pass(spark, sf_dir):
    from locusforge.plans import view

    checked = view.checked(spark, sf_dir)
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    found = qc.report(checked)
    assert found.input_rows == 6059 and found.rejected_rows == 315 and found.rejections["duplicate_variant"] == 116
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before <= 4
