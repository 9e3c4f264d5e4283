"""Registered queries against their SQL on the smallest driver tables.

Some queries by default; all of them with RENTROLL_ALL_QUERIES=1.
"""

import os

import pytest

import __spark_entry__ as entry
from rentroll.driver.queries import QUERIES
from rentroll.driver.shapes import TABLES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
SOME = ["vacancy_loss", "income_normalized", "income_parsed", "income_view", "loan_payments", "dq_table", "dq_ledger", "message_body",
        "csv_scan", "income_upsert_overwrite", "csv_scan_spanning", "land_changed_file", "land_same_file", "upsert_touched",
        "stored_key_lookup", "message_body_bytes", "bill_notice_details", "run_year_rows",
         "loan_payments_null_year", "loan_status_null_year"]
NAMES = sorted(QUERIES) if os.environ.get("RENTROLL_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    at = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
