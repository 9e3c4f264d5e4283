"""Constraint checks as Spark jobs; every check returns (check_id, table, key, reason)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rentroll.schemas import MONEY, Table


def _finding(check_id: str, table: str, key: Column, reason: Column) -> list[Column]:
    return [
        F.lit(check_id).alias("check_id"), F.lit(table).alias("table"),
        key.alias("key"), reason.alias("reason"),
    ]


def _text(columns: Sequence[str]) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def check_key(df: DataFrame, table: str, key: Sequence[str], check_id: str = "primary_key") -> DataFrame:
    """Key values that are missing or used more than once."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(missing | (F.col("_n") > 1))
    reason = F.when(missing, F.lit("missing key")).otherwise(F.lit("duplicate key"))
    return groups.select(*_finding(check_id, table, _text(key), reason))


def check_unique(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Values of a secondary key used more than once; missing values never clash."""
    return (
        df.dropna(subset=list(columns))
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(*_finding("unique", table, _text(columns), F.lit("duplicate value")))
    )


def check_reference(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Referring values without a parent row. Values are grouped before they are joined."""
    used = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.lit(1))
    orphans = used.join(parent.select(F.col(parent_key).alias("_v")), "_v", "left_anti")
    return orphans.select(
        *_finding("foreign_key", table, F.col("_v").cast("string"), F.lit(f"{column} has no parent"))
    )


def check_lengths(df: DataFrame, table: str, key: Sequence[str], lengths: Mapping[str, int]) -> DataFrame:
    """Texts longer than their column allows."""
    findings = F.array(
        *[F.when(F.length(c) > n, F.lit(f"{c} longer than {n}")) for c, n in lengths.items() if c in df.columns]
    )
    return df.select(_text(key).alias("_key"), F.explode(F.array_compact(findings)).alias("_reason")).select(
        *_finding("length", table, F.col("_key"), F.col("_reason"))
    )


def check_readable(
    raw: DataFrame, table: str, key: Sequence[str], parsed: Mapping[str, Column]
) -> DataFrame:
    """Raw texts that are present but were read as NULL. ``parsed`` maps a raw column to its reading."""
    findings = F.array(
        *[
            F.when(F.col(c).isNotNull() & ~F.trim(c).isin("", "-") & value.isNull(), F.lit(f"{c} unreadable"))
            for c, value in parsed.items()
        ]
    )
    return raw.select(_text(key).alias("_key"), F.explode(F.array_compact(findings)).alias("_reason")).select(
        *_finding("unreadable", table, F.col("_key"), F.col("_reason"))
    )


def check_money_fits(df: DataFrame, table: str, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Numbers that do not fit the money type."""
    return check_readable(
        df.select(*key, *[F.col(c).cast("string").alias(c) for c in columns]), table, key,
        {c: F.col(c).try_cast(MONEY) for c in columns},
    )


def check_table(df: DataFrame, table: Table, parents: Mapping[str, DataFrame]) -> DataFrame:
    """All declared checks of one table, money included, in one pass over it; references are checked against the given
    parents. A finding stands once for each key or value and reason, however many rows share it.

    Each row gives a short list of (check, values); equal ones are counted in one aggregation, combined before its
    shuffle, and one anti join takes away the references that have a parent.
    """
    checks: list[tuple[str, str]] = []
    tagged: list[Column] = []
    known: list[DataFrame] = []

    def add(check_id: str, reason: str, columns: Sequence[str], where: Column) -> None:
        values = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
        tagged.append(F.when(where, F.struct(F.lit(len(checks)).alias("check"), values.alias("values"))))
        checks.append((check_id, reason))

    add("primary_key", "duplicate key", table.key, F.lit(True))
    for c in table.unique:
        add("unique", "duplicate value", [c], F.col(c).isNotNull())
    counted = len(checks)  # findings of these are values of several rows
    for c, (parent, parent_key) in table.references.items():
        if parent in parents:
            value = F.col(parent_key).try_cast(df.schema[c].dataType).cast("string")
            known.append(parents[parent].select(F.lit(len(checks)).alias("check"), F.array(value).alias("values")))
            add("foreign_key", f"{c} has no parent", [c], F.col(c).isNotNull())
    for c, n in table.lengths.items():
        if c in df.columns:
            add("length", f"{c} longer than {n}", table.key, F.length(c) > n)
    for field in table.schema.fields:
        if field.dataType.simpleString() == MONEY and field.name in df.columns:
            raw = F.col(f"`{field.name}`").cast("string")
            unfit = raw.isNotNull() & ~F.trim(raw).isin("", "-") & raw.try_cast(MONEY).isNull()
            add("unreadable", f"{field.name} unreadable", table.key, unfit)

    found = df.select(F.explode(F.array_compact(F.array(*tagged))).alias("_t")).select("_t.*")
    found = found.groupBy("check", "values").agg(F.count(F.lit(1)).alias("_n"))
    missing = (F.col("check") == 0) & F.exists("values", lambda v: v.isNull())
    found = found.filter((F.col("check") >= counted) | (F.col("_n") > 1) | missing)
    if known:
        found = found.join(reduce(DataFrame.unionAll, known), ["check", "values"], "left_anti")

    def told(place: int) -> Column:
        return F.element_at(F.array(*[F.lit(check[place]) for check in checks]), F.col("check") + 1)

    return found.select(
        told(0).alias("check_id"), F.lit(table.name).alias("table"), F.array_join("values", "|", "NULL").alias("key"),
        F.when(missing, F.lit("missing key")).otherwise(told(1)).alias("reason"),
    )


def require_year(year: int | None) -> int:
    """The processing year must be set."""
    if not year:
        raise ValueError("the processing year is not set")
    return int(year)


def year_column(year: Column | int | None) -> Column:
    """The processing year as a column: a set number, or an expression over the rows."""
    return (year if isinstance(year, Column) else F.lit(require_year(year))).cast("int")
