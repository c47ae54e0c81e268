"""Each query of the catalogue against its SQL on the driver's smallest tables."""

import math

import duckdb
import pytest

from locusforge.plans import catalogue

TABLES = ["lineitem"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def tidy(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.ORACLES[name])
    assert tidy([tuple(r) for r in got.collect()], got.columns) == tidy(want.fetchall(), want.columns)


def test_expected_counts_of_the_derived_study(spark, sf_dir):
    row = catalogue.QUERIES["qc_accounting"](spark, sf_dir).first()
    assert (row.input_rows, row.accepted_rows, row.rejected_rows) == (6059, 5802, 315)
    counts = {r.reason: r.n for r in catalogue.QUERIES["qc_reason_counts"](spark, sf_dir).collect()}
    assert counts["duplicate_variant"] == 116 and counts["unsupported_contig"] == 74 and counts["missing_statistics"] == 22
    assert catalogue.QUERIES["core_plus"](spark, sf_dir).count() == 173


def test_no_window_or_sort_in_one_task(spark, sf_dir):
    for name in ("core_plus", "qc_kept_rows", "row_ids", "block_centres"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan, name
