"""Stored tables: scans and sinks on Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from rentroll.schemas import Table, conform


def read_table(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """Scan a stored table; columns added since it was written read as NULL."""
    return spark.read.schema(table.schema).parquet(path)


def _laid_out(df: DataFrame, partition_by: Sequence[str]):
    # rebalancing writes few files per partition value and splits a value that holds much of the table
    out = df.hint("rebalance", *partition_by) if partition_by else df
    return out.write.partitionBy(*partition_by) if partition_by else out.write


def write_table(df: DataFrame, path: str, table: Table, partition_by: Sequence[str] = ()) -> None:
    """Write a complete table state to a fresh folder; an existing one is an error.

    A new state often reads the old one, so it never goes to the folder it came from.
    """
    _laid_out(conform(df, table.schema), partition_by).mode("errorifexists").parquet(path)


def append_rows(df: DataFrame, path: str, table: Table, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a stored table."""
    _laid_out(conform(df, table.schema), partition_by).mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, table: Table, partition_by: Sequence[str]) -> None:
    """Replace the partitions present in ``df`` and leave the others; a repeated load changes nothing."""
    writer = _laid_out(conform(df, table.schema), partition_by)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
