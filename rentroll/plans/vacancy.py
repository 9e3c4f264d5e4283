"""Vacancy loss: months without rent, at the lowest rent seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rentroll.functions.parse import rent_month, sequence_id, start_month
from rentroll.operators.mutate import apart, append, delete_where
from rentroll.operators.sequence import dense_sequence, last_numbers_by_year
from rentroll.schemas import INCOME, MONEY, conform

VACANCY = "Vacancy"
LABEL = "Vacant"


def without_vacancies(income: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """The ledger before any vacancy rows of the given years (all years by default)."""
    own = F.col("transaction_id").startswith(F.concat(F.col("year").cast("string"), F.lit(f"-{LABEL}-")))
    if years is not None:
        own = own & F.col("year").isin(list(years))
    return delete_where(income, own)


def _month_bit(month: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), month.cast("int"))


def rent_months(income: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """For each (year, property, unit): lowest rent and, as month bits, the months that need no row.

    Three fixed-size aggregates, reduced in each task before the one shuffle; a
    unit holding much of the ledger costs no more than any other.
    """
    rows = income.filter(F.col("property").isNotNull() & F.col("unit").isNotNull())
    if years is not None:
        rows = rows.filter(F.col("year").isin(list(years)))
    month = F.month("due_date")
    rent = F.col("transaction_category") == "Rent"
    first = (F.dayofmonth("due_date") == 1) & (F.year("due_date") == F.col("year"))
    standing = (F.col("status") == VACANCY) & first
    # only rent rows and standing vacancy rows can matter; the first, wider test is one Parquet can apply
    rows = rows.filter(rent | (F.col("status") == VACANCY)).filter(rent | standing)
    return rows.groupBy("year", "property", "unit").agg(
        F.min(F.when(rent, F.col("original_amount"))).alias("base_rent"),
        F.bit_or(F.when(F.col("due_date").isNotNull(), _month_bit(month)).otherwise(F.lit(0))).alias("_months"),
    )


def vacant_months(
    income: DataFrame, properties: DataFrame | None, years: Sequence[int] | None = None, acquisition_offset: int = 2
) -> DataFrame:
    """(year, property, unit, month, base_rent) for every month that lacks rent."""
    units = rent_months(income, years).filter(F.col("base_rent").isNotNull())
    if properties is None:
        units = units.withColumn("_start", F.lit(1))
    else:
        dates = properties.groupBy(F.col("id").alias("property")).agg(F.min("acquired_date").alias("_acquired"))
        units = units.join(apart(dates), "property", "left").withColumn(
            "_start", start_month(F.col("_acquired"), F.col("year"), acquisition_offset)
        )
    grid = units.filter(F.col("_start") <= 12).withColumn("month", F.explode(F.sequence("_start", F.lit(12))))
    gap = F.col("_months").bitwiseAND(_month_bit(F.col("month"))) == 0
    return grid.filter(gap).select("year", "property", "unit", "month", "base_rent")


def vacancy_rows(months: DataFrame, existing_ids: DataFrame) -> DataFrame:
    """Ledger rows for vacant months; numbers go on from the highest in ``existing_ids``."""
    last = last_numbers_by_year(existing_ids, "transaction_id", LABEL)
    numbered = dense_sequence(months, ["property", "unit", "month"], ["year"], last)
    first = F.make_date("year", "month", F.lit(1))
    rent = F.col("base_rent").cast(MONEY)
    rows = numbered.select(
        sequence_id(F.col("year"), LABEL, F.col("seq")).alias("transaction_id"),
        F.lit(VACANCY).alias("status"),
        first.alias("date_created"),
        first.alias("due_date"),
        F.lit("Income").alias("type"),
        F.lit("Rent").alias("transaction_category"),
        rent_month(first).alias("rent_month"),
        rent.alias("original_amount"),
        rent.alias("vacancy"),
        "property",
        "unit",
        "year",
    )
    return conform(rows, INCOME.schema)


def generate_vacancy_loss(
    income: DataFrame,
    properties: DataFrame | None = None,
    years: Sequence[int] | None = None,
    recompute: bool = False,
    acquisition_offset: int = 2,
) -> DataFrame:
    """The vacancy rows the ledger lacks, for the given years or every year it holds.

    With ``recompute`` earlier vacancy rows count as deleted; add the result to
    ``without_vacancies(income, years)`` then, and to ``income`` otherwise.
    """
    base = without_vacancies(income, years) if recompute else income
    return vacancy_rows(vacant_months(base, properties, years, acquisition_offset), base)


def ledger_with_vacancy_loss(
    income: DataFrame,
    properties: DataFrame | None = None,
    years: Sequence[int] | None = None,
    recompute: bool = False,
    acquisition_offset: int = 2,
) -> DataFrame:
    """The complete ledger after the vacancy step."""
    base = without_vacancies(income, years) if recompute else income
    rows = generate_vacancy_loss(income, properties, years, recompute, acquisition_offset)
    return append(base, rows).select(*income.columns)
