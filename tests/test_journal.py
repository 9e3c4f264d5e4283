"""A journal's steps: recorded, resumed, run anew for other input."""

import os

import pytest
from pyspark.sql import functions as F

from rentroll.operators.lookup import LoanRule
from rentroll.plans import year_run
from rentroll.plans.year_run import run_year
from rentroll.schemas import BANK_PAYMENT, INCOME, STAGING
from rentroll.sources.journal import Journal, fingerprint


def test_fingerprint(rows):
    a = [(1, "x", 2.0), (2, None, None), (2, None, None)]
    ddl = "a int, `b c` string, d double"
    assert fingerprint(rows(a, ddl)) == fingerprint(rows(a[::-1], ddl).repartition(3))
    others = [a[:2], a[1:], [*a, a[0]], [(1, "x", 2.5), *a[1:]], []]
    assert len({fingerprint(rows(o, ddl)) for o in [a, *others]}) == len(others) + 1
    assert fingerprint(rows(a, ddl)) != fingerprint(rows(a, "a bigint, `b c` string, d double"))


def test_steps_are_resumed(spark, rows, tmp_path):
    path, fail = str(tmp_path), True

    def run(given):
        journal = Journal(spark, path, given)
        one = journal.step("one", lambda: {"t": rows([(1, "a")], "a int, b string"), "none": rows([], "a int")})

        def second():
            if fail:
                raise OSError("lost")
            return {"t": one["t"].withColumn("c", F.col("a") + 1)}

        return journal, journal.step("two", second)

    with pytest.raises(OSError, match="lost"):
        run("x")
    fail = False
    journal, out = run("x")
    assert journal.ran == ["two"] and [tuple(r) for r in out["t"].collect()] == [(1, "a", 2)]
    files = sorted(os.listdir(f"{path}/data"))
    journal, out = run("x")
    assert journal.ran == [] and out["t"].columns == ["a", "b", "c"] and sorted(os.listdir(f"{path}/data")) == files
    journal, _ = run("y")
    assert journal.ran == ["one", "two"]
    # a record that its writer did not finish counts as none
    for name in os.listdir(f"{path}/steps"):
        if name.startswith("0002-"):
            with open(f"{path}/steps/{name}", "w") as half:
                half.write('{"t": {"fol')
            crc = f"{path}/steps/.{name}.crc"
            if os.path.exists(crc):
                os.remove(crc)
    journal, out = run("x")
    assert journal.ran == ["two"] and out["t"].count() == 1


def test_a_year_run_goes_on_where_it_failed(rows, tmp_path, monkeypatch):
    staging = rows([(1, 7, "DEBIT", "2025-01-02", "ORIG CO NAME:BIG LOANS ORIG ID:1", "75.00", "ACH", 2025, None)],
                   "id bigint, file_id int, details string, posting_date string, description string, amount string, type string, year int, is_processed string")
    missing = [f for f in STAGING.schema.fields if f.name not in staging.columns]
    staging = staging.select(*[F.col(f.name).cast(f.dataType) for f in STAGING.schema.fields if f not in missing],
                             *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]).select(*STAGING.schema.names)
    tables = {"property": rows([(1, "A", None)], "id bigint, name string, acquired_date date"), "income": rows([], INCOME.ddl),
              "bank_payment": rows([], BANK_PAYMENT.ddl), "bank_transaction_staging": staging}
    rules = [LoanRule("ORIG CO NAME:BIG", "A")]

    def run():
        return run_year(tables, 2025, loan_rules=rules, journal=str(tmp_path))

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(year_run, "ledger_with_vacancy_loss", lost)
        with pytest.raises(OSError, match="lost"):
            run()
    monkeypatch.setattr(year_run, "derive_loan_payments", lost)  # recorded, so not run again
    out = run()
    assert [r["transaction_id"] for r in out["bank_payment"].collect()] == ["2025-BANKPAY-1"]
    assert [r["is_processed"] for r in out["bank_transaction_staging"].collect()] == ["Y"]
    monkeypatch.setattr(year_run, "ledger_with_vacancy_loss", lost)
    assert {t: df.count() for t, df in run().items()} == {t: df.count() for t, df in out.items()}
    tables["property"] = rows([(1, "B", None)], "id bigint, name string, acquired_date date")
    with pytest.raises(OSError, match="lost"):
        run()
