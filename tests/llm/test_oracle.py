"""Each operator's SQL against its query: on the driver's smallest tables, and on texts made to be awkward."""

import duckdb
import pytest

from locusforge.llm import entry, oracle, pii, secrets
from tests.llm import brute

TABLES = ["documents", "benchmark", "pages"]


def tidy(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf_dir), con.sql(entry.oracle_sql()[name])
    assert tidy([tuple(r) for r in got.collect()], got.columns) == tidy(want.fetchall(), want.columns)


@pytest.mark.parametrize("report, sql", [(pii.pii_report, oracle.PERSONAL), (secrets.secrets_report, oracle.SECRETS)])
def test_spans_equal_sql_on_awkward_texts(spark, report, sql):
    texts = [*brute.noisy_texts(400, 9)[:-4], "GB82 WEST 1234 5698 7654 32", "xGB82WEST12345698765432", "ssn: 078-05-1120", "ssn 1078-05-1120", "ghp_" + "a" * 36]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    got, want = report(brute.docs(spark, texts)), con.sql(sql)
    assert tidy([tuple(r) for r in got.collect()], got.columns) == tidy(want.fetchall(), want.columns)
