"""Reporting views: ledgers with the names of what they refer to.

Each dimension is reduced to one row per key first, which keeps the row count of
the ledger and lets the optimizer drop a join whose columns a report does not use.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from rentroll.operators.mutate import apart


def _named(dim: DataFrame, key: str, name: str, ref: str, out: str) -> DataFrame:
    """(reference column, name), unique by reference."""
    return apart(dim.groupBy(F.col(key).alias(ref)).agg(F.min(name).alias(out)))


def with_names(df: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    for ref, dim in dims.items():
        df = df.join(dim, ref, "left")
    return df


def income_view(
    income: DataFrame, tenants: DataFrame, properties: DataFrame, units: DataFrame, leases: DataFrame
) -> DataFrame:
    dims = {
        "payer": _named(tenants, "tenant_id", "name", "payer", "payer_name"),
        "property": _named(properties, "id", "name", "property", "property_name"),
        "unit": _named(units, "id", "name", "unit", "unit_name"),
        "leasenum": _named(leases, "lease_number", "lease_number", "leasenum", "lease_number"),
    }
    return with_names(income, dims).select(
        *income.columns, F.col("year").alias("income_year"), "payer_name", "property_name", "unit_name", "lease_number"
    )


def vacancy_view(income: DataFrame, properties: DataFrame, units: DataFrame) -> DataFrame:
    dims = {
        "property": _named(properties, "id", "name", "property", "_property_name"),
        "unit": _named(units, "id", "name", "unit", "_unit_name"),
    }
    return with_names(income.filter(F.col("status") == "Vacancy"), dims).select(
        "transaction_id", "status", "date_created", "year", "rent_month", "vacancy",
        F.col("_property_name").alias("property"), F.col("_unit_name").alias("unit"),
    )


def expense_view_full(
    expenses: DataFrame, properties: DataFrame, units: DataFrame, categories: DataFrame, providers: DataFrame
) -> DataFrame:
    """Every expense column with the descriptive ones."""
    dims = {
        "property": _named(properties, "id", "name", "property", "property_name"),
        "unit": _named(units, "id", "name", "unit", "unit_name"),
        "category": _named(categories, "category_id", "category_name", "category", "category_name"),
        "provider": _named(providers, "provider_id", "provider_name", "provider", "provider_name"),
    }
    return with_names(expenses, dims).select(
        *expenses.columns, F.col("year").alias("expense_year"),
        "property_name", "unit_name", "category_name", "provider_name",
    )


def expense_view(
    expenses: DataFrame, properties: DataFrame, units: DataFrame, categories: DataFrame, providers: DataFrame
) -> DataFrame:
    """The descriptive columns only."""
    return expense_view_full(expenses, properties, units, categories, providers).select(
        "expense_year", "property_name", "unit_name", "category_name", "provider_name"
    )


def register_views(views: Mapping[str, DataFrame]) -> None:
    """Offer views to SQL by name."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
