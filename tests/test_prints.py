"""Prints of rows, and the rows that a landing or a year run stores."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rentroll import session
from rentroll.functions import prints
from rentroll.operators import mutate


def stored(spark, label):
    """The folders of a label under the shared folder."""
    top = f"{session.shared_dir(spark)}/rentroll"
    return [d for d in (os.listdir(top) if os.path.isdir(top) else []) if d.startswith(f"{label}-")]


def test_exact_sum(rows):
    ends = [-(2**63), 2**63 - 1, -1, 0, 1, 2**42, -(2**42) - 1]
    held = [*ends, *ends, *(random.Random(3).randrange(-(2**63), 2**63) for _ in range(500)), None]
    got = rows([(v,) for v in held], "v bigint").repartition(3).agg(prints.exact_sum(F.col("v"))).first()[0]
    assert int(got) == sum(v for v in held if v is not None)
    assert rows([], "v bigint").agg(prints.exact_sum(F.col("v"))).first()[0] is None


def test_row_hash_tells_nulls_and_columns_apart(rows):
    held = [("x", None), (None, "x"), ("x", ""), ("", "x"), ("x", "x"), (None, None), ("", ""), (None, ""), ("", None)]
    told = rows(held, "a string, b string").select(prints.row_hash([F.col("a"), F.col("b")], F.lit("s")).alias("h")).collect()
    assert len({r["h"] for r in told}) == len(held)


def test_landing_the_same_file_stores_no_rows(spark, rows):
    from rentroll.plans import bank

    raw = rows([("/in/a.csv", i, "DEBIT", "01/02/2025", f"row {i}", f"{i}.00", "ACH") for i in range(5)],
               "source_file string, n int, details string, `posting date` string, description string, amount string, type string")
    files = rows([(1, "/in/a.csv")], "id bigint, file_path string")
    first = bank.land_bank_export(raw, files, 2025, order_by=["source_file", "n"])
    before = stored(spark, "scanned")
    again = bank.land_files(raw, files, 2025, first, ["source_file", "n"])
    assert [r["action"] for r in again.files.collect()] == ["same"] and again.landed.count() == 0
    assert sorted(again.staging.collect()) == sorted(first.collect())
    assert stored(spark, "scanned") == before


@pytest.mark.parametrize("overwrite", [False, True])
def test_settled_upsert_is_the_same(spark, rows, overwrite):
    ddl = "k string, year int, v string"
    target, batch = rows([("1", 2025, "a"), ("2", 2024, "b")], ddl), rows([("1", 2025, "c"), ("2", 2025, "d"), ("3", 2025, "e")], ddl)
    plain, settled = (mutate.guarded_upsert(target, batch, "k", "year", ["v"], overwrite, settle) for settle in (False, True))
    assert sorted(plain.table.collect()) == sorted(settled.table.collect())
    assert sorted(plain.actions.collect()) == sorted(settled.actions.collect())


def test_run_year_rows_stores_its_inputs_once(spark):
    from rentroll.driver.queries import QUERIES

    before = {label: len(stored(spark, label)) for label in ("staging", "resolved", "known")}
    QUERIES["run_year_rows"](spark, "/root/testdata/sf0.001")
    assert {label: len(stored(spark, label)) - n for label, n in before.items()} == {"staging": 1, "resolved": 1, "known": 1}
