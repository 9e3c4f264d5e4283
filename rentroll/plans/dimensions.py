"""Dimension refresh from CSV rows of text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from rentroll.functions.text import empty_to_null
from rentroll.operators.lookup import ensure_placeholder_property
from rentroll.operators.mutate import partial_upsert
from rentroll.schemas import EXPENSE_CATEGORY, PROPERTY, PROVIDER, UNITS, Table
from rentroll.sources.csv import LINE_COLUMNS

# columns that may be blank; the other numbers are mandatory and a bad one is an error
OPTIONAL = {"property": {"acquired_date"}, "units": {"is_unit_group", "group_reference"}}


def typed_rows(raw: DataFrame, table: Table) -> DataFrame:
    """The table's columns the source has, cast from text, and the line columns."""
    optional = OPTIONAL.get(table.name, set())
    cols = []
    for f in table.schema.fields:
        if f.name not in raw.columns:
            continue
        value = empty_to_null(F.col(f.name)) if f.name in optional else F.col(f.name)
        cols.append(value.cast(f.dataType).alias(f.name))
    return raw.select(*cols, *[c for c in LINE_COLUMNS if c in raw.columns])


def refresh_dimension(
    current: DataFrame, raw: DataFrame, table: Table, order_by: Sequence[str] = LINE_COLUMNS
) -> DataFrame:
    """Upsert by key; stored values of columns the source lacks stay. The last row of a key wins."""
    rows = typed_rows(raw, table)
    given = [c for c in table.schema.names if c in rows.columns and c not in table.key]
    return partial_upsert(current, rows, table.key, given, order_by).select(*current.columns)


def refresh_dimensions(
    current: Mapping[str, DataFrame], raw: Mapping[str, DataFrame], order_by: Sequence[str] = LINE_COLUMNS
) -> dict[str, DataFrame]:
    """New states of the property, units, expense_category and provider tables.

    Tables without a source stay as they are; the placeholder property is always there.
    """
    out = dict(current)
    for table in (PROPERTY, UNITS, EXPENSE_CATEGORY, PROVIDER):
        if table.name in raw:
            out[table.name] = refresh_dimension(current[table.name], raw[table.name], table, order_by)
    out["property"] = ensure_placeholder_property(out["property"])
    return out
