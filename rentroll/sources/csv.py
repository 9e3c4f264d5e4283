"""Tolerant CSV scans: every value a trimmed string, bad records set aside."""

from __future__ import annotations

import csv as text_csv
import io
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rentroll.functions.text import trimmed
from rentroll.session import durable
from rentroll.sources.records import any_open_line, assembled, first_lines, placed_records, read_lines

LINE_COLUMNS = ("source_file", "line_block", "line_at")
_BAD = "_bad_record"


class CsvScan(NamedTuple):
    rows: DataFrame  # one string column per normalized header, then the line columns
    rejects: DataFrame  # source_file, record, reason


def normalize_header(name: str) -> str:
    return name.strip().lower()


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def check_input(spark: SparkSession, path: str | None) -> str:
    """The path must be given, exist, and name a CSV file or a folder, in that order."""
    if path is None or not path.strip():
        raise ValueError("CSV file path is empty")
    found, fs = _hadoop_path(spark, path)
    if not fs.exists(found):
        raise FileNotFoundError(f"CSV file not found: {path}")
    if not fs.getFileStatus(found).isDirectory() and not path.lower().endswith(".csv"):
        raise ValueError(f"input must be a CSV file: {path}")
    return path


def _field_count(record) -> F.Column:
    unquoted = F.regexp_replace(record, '"(?:[^"]|"")*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1


OPTIONS = {"quote": '"', "escape": '"'}
GLOB = "*.[cC][sS][vV]"
BOM = "\ufeff"


def _distinct_names(headers: list[str]) -> list[str]:
    """As the CSV reader names columns: a missing name is _c and its place, one that occurs again gets its place."""
    folded = [h.lower() for h in headers]
    return [f"_c{i}" if not h else f"{h}{i}" if folded.count(f) > 1 else h for i, (h, f) in enumerate(zip(headers, folded, strict=True))]


def _schema(headers: list[str]) -> StructType:
    return StructType([StructField(h, StringType()) for h in headers] + [StructField(_BAD, StringType())])


def _from_reader(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Headers, and (values, line columns) of files in which every line is a record."""
    def reader():
        return spark.read.options(header=True, pathGlobFilter=GLOB, **OPTIONS)

    headers = reader().csv(path).columns
    read = (
        reader().schema(_schema(headers))
        .option("columnNameOfCorruptRecord", _BAD)
        # a file whose header differs must not be read under wrong names
        .option("enforceSchema", False)
        # a pruned parser would not notice short records
        .option("columnPruning", False)
        .csv(path)
    )
    return headers, read.select(
        *[F.col(f"`{h}`") for h in headers], F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("line_block"), F.monotonically_increasing_id().alias("line_at"), F.col(_BAD))


def _from_lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, DataFrame]:
    """The same of files in which a quoted value may hold line breaks; and the lines that are no record."""
    placed = placed_records(read_lines(spark, path, GLOB))
    found, broken = assembled(placed)
    heads = durable(first_lines(placed), "heads")
    at = [found[c] == heads[c] for c in LINE_COLUMNS]
    head = F.regexp_replace("record", f"^{BOM}", "")
    told = [r["head"] for r in found.join(heads, at, "left_semi").select(head.alias("head")).distinct().limit(2).collect()]
    if len(told) != 1:
        raise ValueError(f"CSV headers differ: {told[0]!r}, {told[1]!r}" if told else f"no header in {path}")
    names = _distinct_names(next(text_csv.reader(io.StringIO(told[0]))))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in _schema(names))
    options = {**OPTIONS, "columnNameOfCorruptRecord": _BAD}
    body = found.filter(F.trim("record") != "").join(heads, at, "left_anti")
    values = body.select(F.from_csv("record", schema, options).alias("v"), "source_file", "line_block", "line_at")
    return names, values.select(*[F.col(f"v.`{n}`") for n in names], "source_file", "line_block", "line_at", F.col(f"v.{_BAD}")), broken


def scan_csv(
    spark: SparkSession, path: str, multiline: bool | None = None, strict: bool = False
) -> CsvScan:
    """Read a CSV file, or a folder of CSV files with the same header.

    A record lacking fields goes to ``rejects`` (or raises when ``strict``);
    surplus fields are dropped. Files are split among tasks, those too in which a
    quoted value holds a line break; ``multiline`` states whether any does, and saves the
    look, which ends at the first line found. A quoted value of more than ``records.RECORD_LINES`` lines, as a quote
    that nothing closes makes, is rejected line by line.
    """
    check_input(spark, path)
    if multiline is None:
        multiline = any_open_line(spark, path, GLOB)
    if not multiline:
        headers, read = _from_reader(spark, path)
        broken = None
    else:
        headers, read, broken = _from_lines(spark, path)
    names = [normalize_header(h) for h in headers]
    named = read.select(*[trimmed(F.col(f"`{h}`")).alias(n) for h, n in zip(headers, names)], *LINE_COLUMNS, _BAD)
    # a short record lacks its last field; naming that field also keeps the reader parsing whole
    # records, since it refuses to read the record text alone
    lacking = F.col(_BAD).isNotNull() & F.col(f"`{names[-1]}`").isNull()
    short = lacking & (_field_count(F.col(_BAD)) < len(headers))
    rejects = named.filter(short).select(
        "source_file", F.col(_BAD).alias("record"), F.lit("record lacks fields").alias("reason")
    )
    if broken is not None:
        rejects = rejects.unionByName(broken.withColumn("reason", F.lit("quoted value does not end")))
    if strict and rejects.limit(1).count():
        row = rejects.first()
        raise ValueError(f"{row['reason']}: {row['record']!r}")
    return CsvScan(named.filter(~short).drop(_BAD), rejects)


# Ledger name -> header of the invoice export.
INVOICE_HEADERS = {
    "transaction_id": "transaction id",
    "status": "status",
    "date_created": "date created",
    "due_date": "due date",
    "date_paid": "date paid",
    "type": "type",
    "transaction_category": "transaction category",
    "original_amount": "total amount",
    "payment": "paid amount",
    "balance": "left amount",
    "method_of_payment": "method of payment",
    "payer": "payer/payee",
    "payer_email": "payer/payee email",
    "leasenum": "lease #",
    "property": "property name",
    "unit": "unit #",
    "transaction_details": "transaction details",
}


def map_columns(df: DataFrame, mapping: Mapping[str, str] = INVOICE_HEADERS) -> DataFrame:
    """Rename export headers to ledger names; a header the file lacks gives NULLs."""
    there = set(df.columns)
    mapped = [
        (F.col(f"`{normalize_header(h)}`") if normalize_header(h) in there else F.lit(None).cast("string")).alias(n)
        for n, h in mapping.items()
    ]
    return df.select(*mapped, *[c for c in LINE_COLUMNS if c in there])
