"""Bank exports: landing, loan payments and utility expenses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rentroll.functions import parse, prints, text
from rentroll.operators.lookup import (
    PLACEHOLDER_ID,
    LoanRule,
    loan_property_name,
    required_key,
    resolve_property,
    rule_prefixes,
)
from rentroll.operators.mutate import apart, append, full_upsert, one_per_key
from rentroll.operators.quality import year_column
from rentroll.operators.sequence import dense_sequence, last_numbers_by_year, number_file_rows
from rentroll.schemas import BANK_PAYMENT, EXPENSE, MONEY, STAGING, conform
from rentroll.session import durable

PAYMENT_LABEL = "BANKPAY"


def staged_columns(raw: DataFrame, year: Column | int) -> DataFrame:
    """Bank export rows as staging columns, without ids; unreadable dates and amounts are NULL.

    A header that the export lacks gives NULLs. Columns of ``raw`` other than the export's own are carried along.
    """
    export = {
        "details": "details", "posting date": "posting_date", "description": "description", "amount": "amount",
        "type": "type", "check or slip #": "check_num",
    }
    carried = [F.col(f"`{c}`") for c in raw.columns if c not in export and c != "balance"]
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in export if c not in raw.columns})
    texts = raw.select(
        *[
            text.empty_to_null(text.truncated(F.col(c)) if c == "description" else F.col(f"`{c}`")).alias(n)
            for c, n in export.items()
        ],
        year_column(year).alias("year"),
        F.lit(None).cast("string").alias("is_processed"),
        *carried,
    )
    return texts.withColumns(
        {
            "posting_date": parse.parse_posting_date(F.col("posting_date")),
            "amount": parse.parse_money(F.col("amount")),
        }
    )


def with_file_id(rows: DataFrame, manifest: DataFrame, path: str = "source_file") -> DataFrame:
    files = manifest.select(F.col("id").alias("file_id"), F.col("file_path").alias("_path"))
    return rows.join(files, F.col(path) == F.col("_path"), "left").drop("_path")


#: What a bank row says; its ids and its mark are given to it here.
CONTENT = ("details", "posting_date", "description", "amount", "type", "check_num", "year")


def _content(df: DataFrame) -> Column:
    """A row's content as one text, which tells a NULL from an empty text."""
    fields = {f.name: f.dataType for f in STAGING.schema.fields}
    return F.to_json(F.struct(*[F.col(c).cast(fields[c]).alias(c) for c in CONTENT]), {"ignoreNullFields": "false"})


def _file_key() -> Column:
    """Rows that no file of the manifest brought count as one file."""
    return F.coalesce(F.col("file_id"), F.lit(-1).cast("bigint"))


def fingerprints(rows: DataFrame) -> DataFrame:
    """(file_key, rows, print_a, print_b): each file's content as a bag of rows, whatever their order.

    Two independent 64-bit hashes of a row are added up exactly; partial sums are reduced before the shuffle, so
    a file that holds a third of all rows moves one row per task.
    """
    fields = {f.name: f.dataType for f in STAGING.schema.fields}
    content = [F.col(c).cast(fields[c]) for c in CONTENT]
    hashed = rows.select(
        _file_key().alias("file_key"), prints.row_hash(content, F.lit("a")).alias("a"), prints.row_hash(content, F.lit("b")).alias("b"))
    return hashed.groupBy("file_key").agg(
        F.count(F.lit(1)).alias("rows"), prints.exact_sum(F.col("a")).alias("print_a"), prints.exact_sum(F.col("b")).alias("print_b"))


def file_actions(rows: DataFrame, staging: DataFrame) -> DataFrame:
    """(file_key, rows, action) of the files in ``rows``: new, same as stored, or changed. Stored; runs jobs."""
    old = fingerprints(staging).withColumnsRenamed({"rows": "old_rows", "print_a": "old_a", "print_b": "old_b"})
    both = fingerprints(rows).join(old, "file_key", "left")
    same = (F.col("rows") == F.col("old_rows")) & (F.col("print_a") == F.col("old_a")) & (F.col("print_b") == F.col("old_b"))
    action = F.when(F.col("old_rows").isNull(), "new").when(same, "same").otherwise("changed")
    return durable(both.select("file_key", "rows", action.alias("action")), "files")


def _of_files(rows: DataFrame, files: DataFrame, how: str) -> DataFrame:
    keys = files.filter(F.col("action") != "same").select("file_key")
    return rows.withColumn("file_key", _file_key()).join(keys, "file_key", how).select(*rows.columns)


def to_land(rows: DataFrame, staging: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of new and changed files. A row whose content its file held before keeps the mark it had then, so
    that what was paid for is not paid for again; of several marks of equal rows Y counts before N."""
    fresh = _of_files(rows, files, "left_semi").drop("is_processed")
    stored = _of_files(staging, files, "left_semi").filter(F.col("is_processed").isNotNull())
    marks = stored.groupBy(_file_key().alias("file_key"), F.sha2(_content(stored), 256).alias("content")).agg(
        F.max("is_processed").alias("is_processed"))
    keyed = fresh.withColumns({"file_key": _file_key(), "content": F.sha2(_content(fresh), 256)})
    return keyed.join(apart(marks), ["file_key", "content"], "left").select(*rows.columns)


class Landing(NamedTuple):
    staging: DataFrame  # the complete new state
    landed: DataFrame  # the rows that are new in it
    files: DataFrame  # file_key (-1: no file of the manifest), rows, action


def replace_files(staging: DataFrame, landed: DataFrame, files: DataFrame) -> DataFrame:
    """Staging with the rows of changed files replaced and those of new files added."""
    return append(_of_files(staging, files, "left_anti"), landed).select(*staging.columns)


def land_files(
    raw: DataFrame, manifest: DataFrame, year: Column | int, staging: DataFrame, order_by: Sequence[str] | None = None,
    last_id: int = 0,
) -> Landing:
    """Land an export again and again: a file whose content is stored is skipped, a changed one replaces its rows.

    ``raw`` is read twice, the second time for the files that land. Rows that land get ids after the highest stored one
    and ``last_id``. Payments booked for rows that a changed file no
    longer holds stay booked, since payments do not say which row they came from.
    """
    # not stored: where files are the same their rows are only looked at; rows that land are parsed again and then settled
    rows = with_file_id(staged_columns(raw, year), manifest)
    files = file_actions(rows, staging)
    fresh = to_land(rows, staging, files)
    last = max(last_id, staging.agg(F.max("id")).first()[0] or 0)
    if order_by is None:
        numbered = number_file_rows(fresh, last=last)
    else:
        start = rows.sparkSession.range(1).select(F.lit(last).cast("bigint").alias("_last"))
        numbered = dense_sequence(fresh, order_by, start=start, name="id", settle=True)
    landed = conform(numbered, STAGING.schema)
    return Landing(replace_files(staging, landed, files), landed, files)


def land_bank_export(
    raw: DataFrame,
    manifest: DataFrame,
    year: Column | int,
    last_id: int = 0,
    order_by: Sequence[str] | None = None,
    staging: DataFrame | None = None,
) -> DataFrame:
    """Staging rows with file and row ids.

    Scanned files are numbered in file order without moving a row; rows from
    elsewhere are numbered by ``order_by``. With the stored ``staging`` table the rows
    of files that it does not hold, or holds with other content, come back, and ids go on
    after its highest; ``land_files`` gives the whole new state.
    """
    if staging is not None:
        return land_files(raw, manifest, year, staging, order_by, last_id).landed
    rows = with_file_id(staged_columns(raw, year), manifest)
    if order_by is None:
        rows = number_file_rows(rows, last=last_id)
    else:
        start = rows.sparkSession.range(1).select(F.lit(last_id).cast("bigint").alias("_last"))
        rows = dense_sequence(rows, order_by, start=start, name="id", settle=True)
    return conform(rows, STAGING.schema)


def _debit() -> Column:
    return text.equals_ci(F.col("details"), "DEBIT")


class LoanPayments(NamedTuple):
    new_payments: DataFrame
    payments: DataFrame
    staging: DataFrame


def loan_outcomes(staging: DataFrame, rules: Sequence[LoanRule]) -> DataFrame:
    """Staging with lender, property name and outcome: Y payable, N matched but unusable, NULL not ours."""
    lender = F.when(_debit() & F.col("is_processed").isNull(), F.col("_prefix"))
    unusable = F.col("amount").isNull() | F.col("year").isNull()
    outcome = F.when(F.col("lender").isNotNull(), F.when(unusable, F.lit("N")).otherwise(F.lit("Y")))
    named = staging.withColumn("_prefix", text.leading(F.col("description"), rule_prefixes(rules)))
    return named.withColumn("lender", lender).withColumns(
        {"outcome": outcome, "property_name": loan_property_name(F.col("_prefix"), F.col("description"), rules)}
    ).drop("_prefix")


def derive_loan_payments(
    staging: DataFrame,
    rules: Sequence[LoanRule],
    properties: DataFrame,
    payments: DataFrame,
    order_by: Sequence[str] = ("id",),
) -> LoanPayments:
    """Payments for unprocessed debit rows of known lenders, numbered per year in staging order.

    Rows that were processed before are left alone, so a repeated run adds nothing. A row without an amount
    or a year cannot be paid: it is marked N.
    """
    judged = loan_outcomes(staging, rules)
    # plain conjuncts, cheapest first, so that most rows are dropped before their text is looked into
    open_debits = staging.filter(F.col("is_processed").isNull() & _debit() & F.col("amount").isNotNull() & F.col("year").isNotNull())
    lent = open_debits.filter(text.starts_with_any(F.col("description"), rule_prefixes(rules)))
    payable = loan_outcomes(lent, rules).select(
        *order_by, "year", "posting_date", "property_name", "description", "amount"
    )
    placed = resolve_property(payable, properties, "property_name")
    last = last_numbers_by_year(payments, "transaction_id", PAYMENT_LABEL)
    numbered = dense_sequence(placed, order_by, ["year"], last, settle=True)
    zero = F.lit(0).cast(MONEY)
    rows = numbered.select(
        parse.sequence_id(F.col("year"), PAYMENT_LABEL, F.col("seq")).alias("transaction_id"),
        F.col("posting_date").alias("date"),
        "property",
        text.bank_name(F.col("description")).alias("bank"),
        F.col("amount").alias("total_amount"),
        zero.alias("interest"),
        zero.alias("principal"),
        "year",
    )
    rows = conform(rows, BANK_PAYMENT.schema)
    marked = judged.withColumn("is_processed", F.coalesce("outcome", "is_processed")).select(*staging.columns)
    # numbers go on from the stored maximum, so no new id can meet a stored one
    return LoanPayments(rows, append(payments, rows), marked)


@dataclass(frozen=True)
class UtilityRule:
    """A utility's description prefix and how its debits are booked."""

    prefix: str
    provider: str
    above: str  # property for amounts over the threshold
    below: str  # property for the others
    details: str = "Internet Service"
    category: str = "Utility"
    id_prefix: str = "SE"
    threshold: str = "50"
    use_abs: bool = False


class UtilityExpenses(NamedTuple):
    new_expenses: DataFrame
    expenses: DataFrame
    staging: DataFrame


def utility_outcomes(staging: DataFrame, rule: UtilityRule) -> DataFrame:
    """Staging with the trace number, outcome and reject reason of rows the rule matches.

    Rows marked by an earlier run are judged again; their expenses are replaced, not doubled.
    """
    ours = _debit() & text.starts_with_any(F.col("description"), [rule.prefix])
    judged = staging.withColumn("trn", F.when(ours, text.trace_number(F.col("description")))).withColumn("_ours", ours)
    reason = (
        F.when(~F.col("_ours"), F.lit(None))
        .when(F.col("trn").isNull(), F.lit("missing trace number"))
        .when(F.col("posting_date").isNull(), F.lit("missing date"))
        .when(F.col("amount").isNull(), F.lit("missing amount"))
    )
    outcome = F.when(F.col("_ours"), F.when(F.col("reject_reason").isNull(), F.lit("Y")).otherwise(F.lit("N")))
    return judged.withColumn("reject_reason", reason).withColumn("outcome", outcome).drop("_ours")


def _property_key(properties: DataFrame, name: str) -> int:
    row = properties.filter(text.folded(F.col("name")) == name.strip().lower()).agg(F.min("id")).first()
    return PLACEHOLDER_ID if row[0] is None else row[0]


def routed(amount: Column, rule: UtilityRule, above: Column, below: Column) -> Column:
    """One of two values by whether the (signed) amount exceeds the rule's threshold."""
    measured = F.abs(amount) if rule.use_abs else amount
    return F.when(measured > F.lit(rule.threshold).cast(MONEY), above).otherwise(below)


def derive_utility_expenses(
    staging: DataFrame,
    rule: UtilityRule,
    manifest: DataFrame,
    properties: DataFrame,
    categories: DataFrame,
    providers: DataFrame,
    expenses: DataFrame,
    order_by: Sequence[str] = ("id",),
    years: Sequence[int] | None = None,
) -> UtilityExpenses:
    """Expenses keyed by trace number for the utility's debits; the last row of a key wins.

    With ``years`` only their rows are booked and marked.

    The category and provider must exist; they and the two properties are read once.
    """
    category = required_key(categories, "category_name", "category_id", rule.category)
    provider = required_key(providers, "provider_name", "provider_id", rule.provider)
    above, below = (_property_key(properties, n) for n in (rule.above, rule.below))
    judged = utility_outcomes(staging, rule)
    if years is not None:
        judged = judged.withColumn("outcome", F.when(F.col("year").isin(list(years)), F.col("outcome")))
        staging = staging.filter(F.col("year").isin(list(years)))
    debits = staging.filter(_debit() & F.col("posting_date").isNotNull() & F.col("amount").isNotNull())
    ours = debits.filter(text.starts_with_any(F.col("description"), [rule.prefix]))
    traced = ours.withColumn("trn", text.trace_number(F.col("description"))).filter(F.col("trn").isNotNull())
    good = traced.withColumn(
        "transaction", F.concat(F.lit(f"{rule.id_prefix}-"), F.col("year").cast("string"), F.lit("-"), F.col("trn"))
    )
    wanted = ["transaction", "posting_date", "year", "amount", "type", "file_id", *order_by]
    good = one_per_key(good.select(*wanted), ["transaction"], order_by, last=True)
    paths = manifest.select(F.col("id").alias("file_id"), "file_path")
    rows = good.join(paths, "file_id", "left").select(
        "transaction",
        F.col("posting_date").alias("date"),
        "year",
        "amount",
        F.lit(rule.details).alias("details"),
        F.col("type").alias("payment_mode"),
        text.account_from_path(F.col("file_path")).alias("payment_account"),
        routed(F.col("amount"), rule, F.lit(above), F.lit(below)).alias("property"),
        F.lit(category).alias("category"),
        F.lit(provider).alias("provider"),
        F.lit("Operation").alias("type"),
        F.lit("N").alias("exclude"),
        F.lit("N").alias("exclude_zaky"),
    )
    rows = conform(rows, EXPENSE.schema)
    marked = judged.withColumn("is_processed", F.coalesce("outcome", "is_processed")).select(*staging.columns)
    return UtilityExpenses(rows, full_upsert(expenses, rows, ["transaction"]), marked)
