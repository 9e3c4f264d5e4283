"""The file manifest: which inputs were processed, for which year, with what counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from rentroll.operators.mutate import append, partial_upsert
from rentroll.operators.sequence import surrogate_keys

BANK_FILES = "bank_transactions_raw"
INCOME_FILES = "tc_Income"


def register_files(
    manifest: DataFrame, files: DataFrame, file_type: str, processed_at: dt.datetime | None = None
) -> DataFrame:
    """Manifest with one row per path of ``files`` (file_path, year).

    Known paths keep their id and counts; new paths get the next ids in path order.
    """
    stamp = F.lit(processed_at).cast("timestamp") if processed_at else F.current_timestamp()
    seen = files.groupBy("file_path").agg(F.max("year").alias("year"))
    stamped = seen.withColumn("processed_at", stamp).withColumn("file_type", F.lit(file_type))
    new = stamped.join(manifest.select("file_path"), "file_path", "left_anti")
    known = stamped.join(manifest.select("file_path"), "file_path", "left_semi")
    keyed = surrogate_keys(new, ["file_path"], manifest, "id")
    updated = partial_upsert(manifest, known, ["file_path"], ["year", "processed_at", "file_type"])
    return append(updated, keyed).select(*manifest.columns)


def unprocessed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files not yet recorded for their year."""
    return files.join(manifest.select("file_path", "year"), ["file_path", "year"], "left_anti")


def file_counts(staging: DataFrame) -> DataFrame:
    """Total, processed and failed rows for each file; rows no rule applied to count only in the total."""
    return staging.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.coalesce(F.col("is_processed") == "Y", F.lit(False))).alias("success_rows"),
        F.count_if(F.coalesce(F.col("is_processed") == "N", F.lit(False))).alias("failed_rows"),
    )


def write_counts(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """Manifest with the counts of the files in ``counts``."""
    columns = ["total_rows", "success_rows", "failed_rows"]
    rows = counts.withColumnRenamed("file_id", "id").join(manifest.select("id"), "id", "left_semi")
    return partial_upsert(manifest, rows, ["id"], columns)
