"""Edges of numbering, phrase lists, year scope and conflicts."""

import pytest
from pyspark.sql import functions as F

from rentroll.functions import text
from rentroll.operators.sequence import dense_sequence, number_file_rows
from rentroll.plans import bank
from rentroll.schemas import EXPENSE


def test_no_phrases_match_nothing(rows):
    df = rows([("a plain debit",)], "t string")
    got = df.select(text.contains_any(F.col("t"), []), text.leading(F.col("t"), []), text.starts_with_any(F.col("t"), [])).first()
    assert tuple(got) == (False, None, False)


def test_file_numbers_have_no_gaps_where_records_left(rows):
    # positions 2 of the first and 1 of the second split are missing, as after rejects
    data = [("a", 0, 0), ("a", 0, 1), ("a", 0, 3), ("a", 0, 4), ("b", 0, 10), ("b", 0, 12), ("b", 64, 5), ("b", 64, 9)]
    got = number_file_rows(rows(data, "source_file string, line_block bigint, line_at bigint")).collect()
    assert sorted((r["source_file"], r["line_block"], r["line_at"], r["id"]) for r in got) == [(*d, i + 1) for i, d in enumerate(data)]


def test_a_null_group_keeps_its_rows(rows):
    got = dense_sequence(rows([(2025, 1), (2025, 2), (None, 1), (None, 5)], "year int, k int"), ["k"], ["year"]).collect()
    assert sorted((r["year"] or 0, r["k"], r["seq"]) for r in got) == [(0, 1, 1), (0, 5, 2), (2025, 1, 1), (2025, 2, 2)]


def test_utilities_keep_to_their_years(rows):
    staging = rows(
        [(1, 7, "DEBIT", f"{y}-01-02", "ORIG CO NAME:ACME TRN:9", "75.00", "ACH", None, y, None) for y in (2024, 2025)],
        "id bigint, file_id int, details string, posting_date string, description string, amount string, type string, check_num string, "
        "year int, is_processed string",
    ).withColumn("posting_date", F.to_date("posting_date")).withColumn("amount", F.col("amount").cast("decimal(10,2)"))
    out = bank.derive_utility_expenses(
        staging, bank.UtilityRule("ORIG CO NAME:ACME", "Acme", "A", "B"), rows([(7, "/x/Bank_1.CSV")], "id int, file_path string"),
        rows([(1, "A"), (2, "B")], "id int, name string"), rows([(3, "Utility")], "category_id int, category_name string"),
        rows([(4, "Acme")], "provider_id int, provider_name string"), rows([], EXPENSE.ddl), years=[2025])
    assert [r["year"] for r in out.expenses.collect()] == [2025]
    assert sorted((r["year"], r["is_processed"]) for r in out.staging.collect()) == [(2024, None), (2025, "Y")]
