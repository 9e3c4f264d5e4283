"""The registered queries: each runs one operator or job over the driver's whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rentroll.driver.shapes import shape, table
from rentroll.functions import markup, parse, text
from rentroll.operators import lookup, mutate, quality, sequence
from rentroll.operators.lookup import LoanRule
from rentroll.plans import bank, dimensions, ledger, messages, vacancy, views, year_run
from rentroll.plans.bank import UtilityRule
from rentroll.schemas import (
    BANK_PAYMENT,
    EXPENSE,
    EXPENSE_CATEGORY,
    INCOME,
    LEASE,
    LEASE_TENANT,
    PROVIDER,
    UNITS,
    Table,
    conform,
)
from rentroll.session import durable, scratch_path
from rentroll.sources import csv, manifest, versioned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def empty(spark: SparkSession, t: Table) -> DataFrame:
    return spark.createDataFrame([], t.schema)


# --- vacancy -----------------------------------------------------------------


def _income(spark, sf, name="ledger") -> DataFrame:
    rows = shape(spark, sf, name)
    return rows.filter(text.kept_invoice(F.col("status"), F.col("transaction_category"))).drop("line_no")


@register
def vacancy_loss(spark, sf):
    return vacancy.generate_vacancy_loss(_income(spark, sf))


@register
def vacancy_loss_acquired(spark, sf):
    return vacancy.generate_vacancy_loss(_income(spark, sf), shape(spark, sf, "property"))


@register
def vacancy_loss_continued(spark, sf):
    """Earlier vacancy rows stand; numbers go on after them."""
    return vacancy.generate_vacancy_loss(_income(spark, sf, "ledger_with_vacancies"))


@register
def vacancy_loss_recompute(spark, sf):
    """The whole ledger after earlier vacancy rows were replaced."""
    income = _income(spark, sf, "ledger_with_vacancies")
    return vacancy.ledger_with_vacancy_loss(income, shape(spark, sf, "property"), recompute=True)


@register
def vacancy_ids_dense(spark, sf):
    rows = vacancy.generate_vacancy_loss(_income(spark, sf, "ledger_with_vacancies"))
    number = parse.number_after(F.col("transaction_id"), F.concat(F.col("year").cast("string"), F.lit("-Vacant-")))
    return rows.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("first_no"), F.max(number).alias("last_no")
    )


@register
def lowest_rent(spark, sf):
    return vacancy.rent_months(_income(spark, sf)).select("year", "property", "unit", "base_rent")


@register
def next_numbers(spark, sf):
    """The next free vacancy number of each year."""
    last = sequence.last_numbers_by_year(shape(spark, sf, "ledger_with_vacancies"), "transaction_id", "Vacant")
    return last.select("year", (F.col("_last") + 1).alias("next_no"))


# --- invoices ----------------------------------------------------------------


@register
def income_normalized(spark, sf):
    rows = ledger.normalize_invoices(shape(spark, sf, "raw_invoices"))
    return rows.select(
        "line_no", "transaction_id", "status", "type", "transaction_category", "method_of_payment",
        "transaction_details", "exclude_zaky", "sd_applied", "payer", "payer_email", "property_name", "unit_name",
    )


@register
def income_parsed(spark, sf):
    rows = ledger.parse_invoices(ledger.normalize_invoices(shape(spark, sf, "raw_invoices")))
    return rows.select(
        "line_no", "date_created", "due_date", "date_paid", "original_amount", "payment", "balance", "vacancy",
        "leasenum", "rent_month",
    )


@register
def income_rejects(spark, sf):
    rows = ledger.parse_invoices(ledger.normalize_invoices(shape(spark, sf, "raw_invoices")))
    judged = rows.select("line_no", "transaction_id", ledger.reject_reason().alias("reason"))
    return judged.filter(F.col("reason").isNotNull())


@register
def resolve_property_unit(spark, sf):
    rows = ledger.normalize_invoices(shape(spark, sf, "raw_invoices")).drop("property", "unit")
    placed = lookup.resolve_property(rows, shape(spark, sf, "property"), "property_name")
    return lookup.resolve_unit(placed, shape(spark, sf, "units"), "unit_name").select("line_no", "property", "unit")


def _built(spark, sf):
    return ledger.build_income_ledger(
        shape(spark, sf, "raw_invoices"), shape(spark, sf, "property"), shape(spark, sf, "units"),
        empty(spark, INCOME), shape(spark, sf, "known_tenant"), shape(spark, sf, "lease"), empty(spark, LEASE_TENANT),
        F.year("date_created"), order_by=["line_no"], on_conflict="report",
    )


@register
def income_ledger(spark, sf):
    return _built(spark, sf).ledger


def _good_rows(spark, sf) -> DataFrame:
    rows = ledger.parse_invoices(ledger.normalize_invoices(shape(spark, sf, "raw_invoices")))
    rows = rows.filter(ledger.reject_reason().isNull()).drop("property", "unit")
    return rows.withColumn("year", F.year("date_created"))


@register
def tenants_resolved(spark, sf):
    return ledger.resolve_tenants(_good_rows(spark, sf), shape(spark, sf, "known_tenant"), ["line_no"]).tenants


@register
def leases_resolved(spark, sf):
    return _built(spark, sf).leases


@register
def lease_tenant_links(spark, sf):
    return _built(spark, sf).lease_tenants


def _simple_links(spark, sf) -> DataFrame:
    return mutate.distinct_pairs(
        shape(spark, sf, "ledger").select(F.col("leasenum").alias("lease_id"), F.col("payer").alias("tenant_id")),
        ["lease_id", "tenant_id"],
    )


@register
def leases_with_tenants(spark, sf):
    rows = ledger.leases_with_tenants(shape(spark, sf, "lease"), _simple_links(spark, sf))
    return rows.select(
        "lease_number", "property", "unit", "year", "segment",
        F.array_join(F.col("tenants").cast("array<string>"), ",").alias("tenants"),
    )


@register
def lease_member_pages(spark, sf):
    rows = lookup.collect_members(_simple_links(spark, sf), "lease_id", "tenant_id", "tenants", page_size=2)
    return rows.select(
        F.col("lease_id").alias("lease_number"), "segment",
        F.array_join(F.col("tenants").cast("array<string>"), ",").alias("tenants"),
    )


@register
def supplier_part_pages(spark, sf):
    """Members in pages where keys have many: the parts that a supplier shipped."""
    pairs = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    rows = lookup.collect_members(pairs, "l_suppkey", "l_partkey", "parts", page_size=7)
    return rows.select("l_suppkey", "segment", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@register
def lease_summaries(spark, sf):
    rows = ledger.leases_with_tenants(shape(spark, sf, "lease"), _simple_links(spark, sf))
    return ledger.lease_summaries(rows).select(
        "lease_number", F.col("summary.unit").alias("unit"), F.size("summary.tenants").cast("bigint").alias("n")
    )


@register
def tenant_maps(spark, sf):
    rows = ledger.tenant_maps(shape(spark, sf, "tenant"))
    return rows.select(
        "tenant_id", F.col("fields")["name"].alias("name"), F.col("fields")["email"].alias("email"),
        F.size("fields").cast("bigint").alias("n"),
    )


@register
def tenant_latest_by_email(spark, sf):
    return lookup.latest_by_email(shape(spark, sf, "tenant"))


@register
def distinct_property_units(spark, sf):
    return mutate.distinct_pairs(shape(spark, sf, "ledger"), ["property", "unit"])


# --- mutation ----------------------------------------------------------------


def _upsert(spark, sf, overwrite):
    return mutate.guarded_upsert(
        shape(spark, sf, "stored_ledger"), shape(spark, sf, "ledger"), "transaction_id", "year", ["line_no"], overwrite
    )


@register
def income_upsert_keep(spark, sf):
    return _upsert(spark, sf, False).table


@register
def income_upsert_overwrite(spark, sf):
    return _upsert(spark, sf, True).table


@register
def upsert_touched(spark, sf):
    """The overwriting upsert into a stored table, of which only touched buckets are written anew."""
    path = scratch_path(spark, "income-table")
    versioned.create(shape(spark, sf, "stored_ledger"), path, INCOME)
    versioned.merge(
        path, INCOME, shape(spark, sf, "ledger"),
        lambda old, new: mutate.guarded_upsert(old, new, "transaction_id", "year", ["line_no"], True).table)
    return versioned.read(spark, path, INCOME)


@register
def stored_key_lookup(spark, sf):
    """Stored ledger rows of the keys that the urgent orders name, from their buckets only."""
    path = scratch_path(spark, "income-table")
    versioned.create(shape(spark, sf, "stored_ledger"), path, INCOME)
    keys = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").cast("string").alias("transaction_id"))
    return versioned.read_keys(spark, path, INCOME, keys).select("transaction_id", "due_date", "original_amount", "year")


@register
def income_upsert_conflicts(spark, sf):
    actions = _upsert(spark, sf, True).actions
    return actions.filter(F.col("action") == "conflict").select("transaction_id", "scope", "existing_scope")


@register
def income_upsert_actions(spark, sf):
    return _upsert(spark, sf, False).actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register
def first_row_per_key(spark, sf):
    rows = shape(spark, sf, "ledger").select("transaction_id", "line_no", "original_amount", "due_date")
    return mutate.one_per_key(rows, ["transaction_id"], ["line_no"])


def _supplier_rows(spark, sf) -> DataFrame:
    """Provider rows as they come in with shipments: the latest shipment of a supplier counts."""
    lines = table(spark, sf, "lineitem")
    return lines.select(
        F.col("l_suppkey").alias("provider_id"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("provider_name"),
        F.col("l_orderkey").alias("line_order"), F.col("l_linenumber").alias("line_item"),
        F.col("l_partkey").alias("line_part"), F.col("l_shipdate").alias("line_day"),
    )


LINE_ORDER = ["line_order", "line_item", "line_part", "line_day"]


@register
def dim_upsert_full(spark, sf):
    """Known providers are replaced whole, so columns the shipments lack become NULL."""
    known = shape(spark, sf, "provider").filter(F.col("provider_address") < "Nation 2")
    rows = conform(_supplier_rows(spark, sf), PROVIDER.schema, keep_extra=True)
    return mutate.full_upsert(known, rows, ["provider_id"], LINE_ORDER)


@register
def dim_upsert_partial(spark, sf):
    known = shape(spark, sf, "provider").filter(F.col("provider_address") < "Nation 2")
    return mutate.partial_upsert(known, _supplier_rows(spark, sf), ["provider_id"], ["provider_name"], LINE_ORDER)


@register
def update_by_key(spark, sf):
    rows = shape(spark, sf, "ledger")
    return mutate.update_by_key(shape(spark, sf, "stored_ledger"), rows, ["transaction_id"], ["line_no"])


@register
def delete_by_predicate(spark, sf):
    return vacancy.without_vacancies(shape(spark, sf, "ledger_with_vacancies"), [1995, 1996, 1997])


@register
def append_conformed(spark, sf):
    old = shape(spark, sf, "expense").drop("exclude", "check_num")
    new = shape(spark, sf, "expense").select("transaction", "amount", F.col("year").cast("string").alias("year"))
    return mutate.append(conform(old, EXPENSE.schema), conform(new, EXPENSE.schema))


@register
def key_lookup(spark, sf):
    """The ledger rows whose unit belongs to a customer of one market segment."""
    keys = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    keys = keys.select((F.col("c_custkey") + 1).alias("unit"))
    return lookup.key_lookup(shape(spark, sf, "ledger"), "unit", keys).select("line_no", "transaction_id", "unit")


@register
def surrogate_keys(spark, sf):
    """Keys for the distinct part names, after the highest stored key."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind")).distinct()
    return sequence.surrogate_keys(names, ["name", "kind"], shape(spark, sf, "units"), "id")


@register
def placeholder_member(spark, sf):
    return lookup.ensure_placeholder_property(shape(spark, sf, "property"))


# --- bank --------------------------------------------------------------------

BANK_ORDER = ["line_order", "line_item", "line_part", "line_source", "line_day"]
LOAN_RULES = [
    LoanRule("ORIG CO NAME:SUPPLIER#000000001", "ORIG ID:3 ", "NATION_3"),
    LoanRule("ORIG CO NAME:SUPPLIER#000000001", "ORIG ID:4 ", "nation_4"),
    LoanRule("ORIG CO NAME:SUPPLIER#000000001"),
    LoanRule("ORIG CO NAME:SUPPLIER#000000002", None, "NATION_7"),
    LoanRule("ORIG CO NAME:SUPPLIER#000000003", None, "no such property"),
]
UTILITY_RULE = UtilityRule(
    "ORIG CO NAME:SUPPLIER#000000004", provider="Supplier#000000004", above="NATION_1", below="NATION_2",
    category="internet",
)


def _raw_bank(spark, sf) -> DataFrame:
    rows = shape(spark, sf, "raw_bank")
    return rows.withColumnsRenamed({"posting_date": "posting date", "check_or_slip": "check or slip #"})


def _staged(spark, sf) -> DataFrame:
    """Staging rows told apart by their line columns."""
    return bank.staged_columns(_raw_bank(spark, sf), F.year("line_day"))


def _landed(spark, sf) -> DataFrame:
    """The same as a stored table, which is what the steps after landing read."""
    return durable(_staged(spark, sf), "staging")


@register
def bank_staging_landed(spark, sf):
    raw = _raw_bank(spark, sf)
    return bank.land_bank_export(
        raw, shape(spark, sf, "manifest"), F.year("line_day"), order_by=["source_file", *BANK_ORDER]
    )


def _landed_twice(spark, sf, first: DataFrame):
    """An export landed after an earlier one, of which the loan debits were marked."""
    raw, files, order = _raw_bank(spark, sf), shape(spark, sf, "manifest"), ["source_file", *BANK_ORDER]
    earlier = bank.land_bank_export(first, files, F.year("line_day"), order_by=order)
    marked = bank.loan_outcomes(earlier, LOAN_RULES).withColumn("is_processed", F.col("outcome")).select(*earlier.columns)
    return bank.land_files(raw, files, F.year("line_day"), durable(marked, "staging"), order_by=order)


@register
def land_same_file(spark, sf):
    """Landing the same export again: every file is known, nothing lands."""
    done = _landed_twice(spark, sf, _raw_bank(spark, sf))
    landed = done.landed.groupBy(F.col("file_id").alias("file_key")).agg(F.count(F.lit(1)).alias("landed"))
    return done.files.join(landed, "file_key", "left").select("file_key", "rows", "action", F.coalesce("landed", F.lit(0)).alias("landed"))


@register
def land_changed_file(spark, sf):
    """Of a third of the files an earlier export lacked rows, and of another it had other amounts; some were not there."""
    raw, kind = _raw_bank(spark, sf), F.col("line_source") % 100 % 4
    first = raw.filter((kind != 3) & ~((kind == 0) & (F.col("line_item") > 2)))
    first = first.withColumn("amount", F.when((kind == 1) & (F.col("line_item") == 1), "1.00").otherwise(F.col("amount")))
    return _landed_twice(spark, sf, first).staging


@register
def bank_name_extract(spark, sf):
    rows = _staged(spark, sf)
    return rows.groupBy(text.bank_name(F.col("description")).alias("bank")).agg(F.count(F.lit(1)).alias("n"))


@register
def trn_extract(spark, sf):
    return _staged(spark, sf).select(*BANK_ORDER, text.trace_number(F.col("description")).alias("trn"))


@register
def account_from_path(spark, sf):
    rows = shape(spark, sf, "manifest")
    return rows.select("id", text.account_from_path(F.col("file_path")).alias("account"))


@register
def counterparty_rules(spark, sf):
    """Lender prefix and property name by rule."""
    rows = bank.loan_outcomes(_staged(spark, sf), LOAN_RULES)
    return rows.groupBy("lender", "property_name", "outcome").agg(F.count(F.lit(1)).alias("n"))


@register
def loan_payments(spark, sf):
    staged = _landed(spark, sf)
    return bank.derive_loan_payments(
        staged, LOAN_RULES, shape(spark, sf, "property"), empty(spark, BANK_PAYMENT), BANK_ORDER
    ).new_payments


def _undated(spark, sf):
    """Staging whose year is that of the posting date, so NULL where it cannot be read."""
    return durable(bank.staged_columns(_raw_bank(spark, sf), F.year(parse.parse_posting_date(F.trim("posting date")))), "staging")


@register
def loan_payments_null_year(spark, sf):
    """Debits without a year get no payment."""
    return bank.derive_loan_payments(
        _undated(spark, sf), LOAN_RULES, shape(spark, sf, "property"), empty(spark, BANK_PAYMENT), BANK_ORDER
    ).new_payments


@register
def loan_status_null_year(spark, sf):
    """Debits without a year are marked as failed."""
    staging = bank.derive_loan_payments(
        _undated(spark, sf), LOAN_RULES, shape(spark, sf, "property"), empty(spark, BANK_PAYMENT), BANK_ORDER).staging
    return staging.select(*BANK_ORDER, "is_processed")


def _utility(spark, sf):
    categories = empty(spark, EXPENSE_CATEGORY).unionByName(
        table(spark, sf, "part").agg(F.max("p_partkey").alias("category_id"), F.lit("Internet").alias("category_name"))
    )
    staged = bank.with_file_id(_landed(spark, sf), shape(spark, sf, "manifest"))
    return bank.derive_utility_expenses(
        staged, UTILITY_RULE, shape(spark, sf, "manifest"), shape(spark, sf, "property"), categories,
        shape(spark, sf, "provider"), empty(spark, EXPENSE), BANK_ORDER,
    )


@register
def utility_expenses(spark, sf):
    return _utility(spark, sf).new_expenses


@register
def utility_outcomes(spark, sf):
    rows = bank.utility_outcomes(_staged(spark, sf), UTILITY_RULE).filter(F.col("outcome").isNotNull())
    return rows.groupBy("outcome", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def _marked(spark, sf) -> DataFrame:
    """Staging after the loan step and the utility step; neither needs a join to set the status."""
    staged = bank.with_file_id(_landed(spark, sf), shape(spark, sf, "manifest"))
    loans = bank.loan_outcomes(staged, LOAN_RULES)
    loans = loans.withColumn("is_processed", F.coalesce("outcome", "is_processed")).select(*staged.columns)
    judged = bank.utility_outcomes(loans, UTILITY_RULE)
    return judged.withColumn("is_processed", F.coalesce("outcome", "is_processed")).select(*staged.columns)


@register
def staging_status(spark, sf):
    return _marked(spark, sf).select(*BANK_ORDER, "file_id", "is_processed")


@register
def status_update_by_id(spark, sf):
    """Outcomes kept apart from the staging rows, written back by key."""
    staged = _staged(spark, sf).select(*BANK_ORDER, "is_processed")
    outcomes = bank.loan_outcomes(_staged(spark, sf), LOAN_RULES).filter(F.col("outcome").isNotNull())
    outcomes = outcomes.select(*BANK_ORDER, F.col("outcome").alias("is_processed"))
    return mutate.update_column(staged, outcomes, BANK_ORDER, "is_processed")


@register
def file_counts(spark, sf):
    return manifest.file_counts(_marked(spark, sf))


@register
def manifest_counts(spark, sf):
    counts = manifest.file_counts(_marked(spark, sf))
    return manifest.write_counts(shape(spark, sf, "earlier_manifest"), counts).drop("processed_at")


def _files(spark, sf) -> DataFrame:
    return _raw_bank(spark, sf).select(F.col("source_file").alias("file_path"), F.year("line_day").alias("year"))


@register
def file_manifest(spark, sf):
    known = shape(spark, sf, "earlier_manifest")
    return manifest.register_files(known, _files(spark, sf), manifest.BANK_FILES).drop("processed_at")


@register
def unprocessed_files(spark, sf):
    return manifest.unprocessed(_files(spark, sf).distinct(), shape(spark, sf, "manifest"))


# --- views -------------------------------------------------------------------


@register
def income_view(spark, sf):
    return views.income_view(
        shape(spark, sf, "ledger").drop("line_no"), shape(spark, sf, "tenant"), shape(spark, sf, "property"),
        shape(spark, sf, "units"), shape(spark, sf, "lease"),
    )


@register
def vacancy_view(spark, sf):
    return views.vacancy_view(
        shape(spark, sf, "ledger_with_vacancies"), shape(spark, sf, "property"), shape(spark, sf, "units")
    )


def _expense_dims(spark, sf):
    return [shape(spark, sf, n) for n in ("property", "units", "expense_category", "provider")]


@register
def expense_view(spark, sf):
    return views.expense_view(shape(spark, sf, "expense"), *_expense_dims(spark, sf))


@register
def expense_view_full(spark, sf):
    return views.expense_view_full(shape(spark, sf, "expense"), *_expense_dims(spark, sf)).select(
        "transaction", "amount", "expense_year", "property_name", "unit_name", "category_name", "provider_name"
    )


# --- messages ----------------------------------------------------------------


def _messages(spark, sf) -> DataFrame:
    return shape(spark, sf, "messages").withColumnsRenamed({"sender": "from", "is_read": "read"})


@register
def message_search(spark, sf):
    criteria = messages.SearchCriteria(
        sender="user1", start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 20), subject="PURCHASE", body='"k": 1',
        unread_only=True,
    )
    return messages.search(_messages(spark, sf), criteria).select("message_number", "subject", "from", "body")


@register
def message_search_all(spark, sf):
    return messages.search(_messages(spark, sf), messages.SearchCriteria(subject="")).select("message_number")


@register
def message_range(spark, sf):
    rows = messages.in_range(_messages(spark, sf), dt.date(2024, 1, 3), dt.date(2024, 1, 9))
    return rows.select("message_number", "subject")


@register
def message_unread(spark, sf):
    rows = messages.unread_in_range(_messages(spark, sf), dt.date(2024, 1, 3), dt.date(2024, 1, 9))
    return rows.select("message_number", "kind")


@register
def message_recent_days(spark, sf):
    rows = messages.trailing_days(_messages(spark, sf), dt.date(2024, 1, 25))
    return rows.select("message_number", "kind")


@register
def message_top_n(spark, sf):
    return messages.most_recent(_messages(spark, sf), 50).select("message_number", "subject")


@register
def bill_notices(spark, sf):
    rows = messages.bill_notices(_messages(spark, sf), ["error notice 1", "Signup Notice", "click notice 77"])
    return rows.select("message_number", "subject")


@register
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


@register
def message_body(spark, sf):
    return messages.message_bodies(shape(spark, sf, "parts"))


@register
def message_body_pages(spark, sf):
    return messages.message_bodies(shape(spark, sf, "parts"), parts_per_row=2)


@register
def message_body_bytes(spark, sf):
    return messages.bounded_bodies(shape(spark, sf, "parts"), chars_per_row=150)


@register
def bill_notice_details(spark, sf):
    rows = messages.notice_details(
        _messages(spark, sf), shape(spark, sf, "parts"), shape(spark, sf, "recipients"), ["Click Notice", "view notice", "error notice 1"],
        chars_per_row=200, names_per_row=2)
    return rows.select("message_number", "segment", "subject", "from", "received_date", "body",
                       *(F.array_join(c, ",", "-").alias(c) for c in ("attachments", "recipients")))


@register
def bill_notices_no_phrases(spark, sf):
    return messages.bill_notices(_messages(spark, sf), []).select("message_number", "subject")


@register
def message_attachments(spark, sf):
    rows = messages.attachments(shape(spark, sf, "parts"))
    return rows.select("message_number", "segment", F.array_join("attachments", ",").alias("attachments"))


@register
def message_addresses(spark, sf):
    addresses = F.when(F.col("message_number") % 9 != 0, F.array("from", F.lit("second@example.com")))
    return _messages(spark, sf).select("message_number", messages.first_sender(addresses).alias("first_sender"))


# --- checks ------------------------------------------------------------------


@register
def dq_keys(spark, sf):
    raw = shape(spark, sf, "raw_invoices")
    rows = raw.select(text.clean_optional(F.col("transaction_id")).alias("transaction_id"))
    return quality.check_key(rows, "income", ["transaction_id"])


@register
def dq_unique(spark, sf):
    return quality.check_unique(shape(spark, sf, "expense_category"), "expense_category", ["category_name"])


@register
def dq_money_fits(spark, sf):
    """Order totals a thousand times over: those from 100,000 on outgrow the money type."""
    totals = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 1000).cast("decimal(18,2)").alias("total"))
    return quality.check_money_fits(totals, "orders", ["o_orderkey"], ["total"])


@register
def dq_foreign_keys(spark, sf):
    """The ledger against damaged dimensions: leases and tenants are missing some members."""
    rows = shape(spark, sf, "ledger")
    tenants = shape(spark, sf, "known_tenant")
    leases = shape(spark, sf, "lease")
    out = quality.check_reference(rows, "income", "payer", tenants, "tenant_id")
    return out.unionByName(quality.check_reference(rows, "income", "leasenum", leases, "lease_number"))


@register
def dq_lengths(spark, sf):
    return quality.check_lengths(shape(spark, sf, "units"), "units", ["id"], UNITS.lengths)


@register
def dq_unreadable(spark, sf):
    raw = shape(spark, sf, "raw_invoices")
    return quality.check_readable(
        raw, "income", ["line_no"],
        {
            "due_date": parse.parse_date(text.trimmed(F.col("due_date"))),
            "original_amount": parse.parse_money(F.col("original_amount")),
            "leasenum": parse.parse_whole(F.col("leasenum")),
        },
    )


@register
def dq_table(spark, sf):
    parents = {"property": shape(spark, sf, "property").filter(F.col("acquired_date").isNotNull())}
    return quality.check_table(shape(spark, sf, "units"), UNITS, parents)


@register
def dq_ledger(spark, sf):
    """Every declared check of the ledger in one pass; some statuses are too long, large amounts outgrow the money type."""
    rows = shape(spark, sf, "ledger").withColumns({
        "status": F.when(F.col("line_no") % 10 == 3, F.concat("status", F.lit(" in full"))).otherwise(F.col("status")),
        "original_amount": (F.col("original_amount") * 100000).cast("decimal(24,2)"),
    })
    parents = {"tenant": "known_tenant", "lease": "lease", "property": "property", "units": "units"}
    return quality.check_table(rows, INCOME, {name: shape(spark, sf, held) for name, held in parents.items()})


# --- files -------------------------------------------------------------------


def _write_csv(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


@register
def csv_scan(spark, sf):
    """The bank rows written as an export, scanned and typed."""
    raw = shape(spark, sf, "raw_bank").withColumn("year", F.year("line_day").cast("string"))
    out = raw.select(
        F.col("details").alias("Details"), F.col("posting_date").alias(" Posting Date"),
        F.col("description").alias("Description"), F.col("amount").alias("Amount"), F.col("type").alias("Type"),
        F.col("balance").alias("Balance"), F.col("check_or_slip").alias("Check or Slip #"),
    )
    scan = csv.scan_csv(spark, _write_csv(out, "bank-csv"))
    rows = bank.staged_columns(scan.rows, 1998)
    return rows.select("details", "posting_date", "description", "amount", "type", "check_num")


@register
def csv_scan_spanning(spark, sf):
    """The bank rows as an export whose descriptions hold line breaks: split among tasks like any other."""
    text, third = F.col("description"), F.col("line_item") % 3
    spanned = F.when(third == 0, text).when(third == 1, F.concat(F.lit('a "b",\n'), text)).otherwise(F.concat(text, F.lit('\n\n"\nend, of')))
    out = shape(spark, sf, "raw_bank").select(
        F.col("source_file").alias("Path"), spanned.alias("Description "), F.col("amount").alias("Amount"),
        F.col("check_or_slip").alias("Check or Slip #"))
    scan = csv.scan_csv(spark, _write_csv(out, "spanning-csv"))
    return scan.rows.select(F.col("path").alias("source_file"), "description", "amount", F.col("check or slip #").alias("check_num"))


@register
def csv_file_numbers(spark, sf):
    """Row numbers in file order: dense over all files."""
    out = shape(spark, sf, "provider").select("provider_id", "provider_name")
    scan = csv.scan_csv(spark, _write_csv(out, "provider-csv"), multiline=False)
    numbered = sequence.number_file_rows(scan.rows, name="id")
    return numbered.agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.sum("id").alias("sum_id"),
    )


@register
def csv_column_mapping(spark, sf):
    """An invoice export under its own headers, mapped to ledger names."""
    raw = shape(spark, sf, "raw_invoices")
    heads = [F.col(n).alias(h.title()) for n, h in csv.INVOICE_HEADERS.items() if n != "unit"]
    scan = csv.scan_csv(spark, _write_csv(raw.select(*heads), "invoice-csv"), multiline=False)
    rows = csv.map_columns(scan.rows)
    return rows.select("transaction_id", "status", "due_date", "original_amount", "leasenum", "unit")


@register
def dims_refresh(spark, sf):
    """Properties refreshed from a CSV without acquisition dates, which therefore stay."""
    current = {
        "property": shape(spark, sf, "property").filter(F.col("full_address") < "Region 3"),
        "provider": shape(spark, sf, "provider"),
    }
    nation = table(spark, sf, "nation")
    out = nation.select(
        (F.col("n_nationkey") + 1).alias("ID"), F.lower("n_name").alias("Name"), F.lit("addr").alias("Full_Address"),
        F.col("n_regionkey").alias(" Number_of_units"),
    )
    scan = csv.scan_csv(spark, _write_csv(out, "property-csv"), multiline=False)
    return dimensions.refresh_dimensions(current, {"property": scan.rows})["property"]


def _year_tables(spark, sf) -> dict[str, DataFrame]:
    tables = {
        "property": shape(spark, sf, "property"), "units": shape(spark, sf, "units"),
        "income": empty(spark, INCOME), "tenant": shape(spark, sf, "known_tenant"),
        "lease": empty(spark, LEASE), "lease_tenant": empty(spark, LEASE_TENANT),
        "bank_payment": empty(spark, BANK_PAYMENT), "file_processing": shape(spark, sf, "manifest"),
        "provider": shape(spark, sf, "provider"), "expense": empty(spark, EXPENSE),
        "expense_category": table(spark, sf, "part").agg(
            F.max("p_partkey").alias("category_id"), F.lit("Internet").alias("category_name")
        ),
    }
    # stored as they are given to the run, which reads them more than once
    staged = durable(bank.with_file_id(_staged(spark, sf), tables["file_processing"]), "staging")
    return tables | {"bank_transaction_staging": staged}


@register
def run_year(spark, sf):
    """All steps in order; rows and money per resulting table and year."""
    out = year_run.run_year(
        _year_tables(spark, sf), F.year("date_created"), shape(spark, sf, "raw_invoices"), None, LOAN_RULES, UTILITY_RULE,
        order_by=["line_no"], staging_order=BANK_ORDER, on_conflict="report",
    )

    def summary(name: str, amount: str) -> DataFrame:
        return out[name].groupBy(F.lit(name).alias("ledger"), "year").agg(
            F.count(F.lit(1)).alias("n"), F.sum(amount).cast("decimal(20,2)").alias("total")
        )

    return (
        summary("income", "original_amount")
        .unionByName(summary("bank_payment", "total_amount"))
        .unionByName(summary("expense", "amount"))
    )


@register
def run_year_rows(spark, sf):
    """All steps in order, stored in a journal, and again from it; the rows that the second run reads."""
    journal = scratch_path(spark, "year-run")
    given, invoices = _year_tables(spark, sf), durable(shape(spark, sf, "raw_invoices"), "invoices")  # both runs read the same

    def run() -> dict[str, DataFrame]:
        return year_run.run_year(
            given, F.year("date_created"), invoices, None, LOAN_RULES, UTILITY_RULE,
            order_by=["line_no"], staging_order=BANK_ORDER, on_conflict="report", journal=journal,
        )

    run()
    out = run()

    def rows(name: str, key: str, day: str, amount: str) -> DataFrame:
        return out[name].select(F.lit(name).alias("ledger"), F.col(key).cast("string").alias("key"), F.col(day).cast("date").alias("day"), "property",
                                F.col(amount).cast("decimal(20,2)").alias("amount"), "year")

    return reduce(DataFrame.unionByName, [
        rows("income", "transaction_id", "due_date", "original_amount"), rows("bank_payment", "transaction_id", "date", "total_amount"),
        rows("expense", "transaction", "date", "amount")])
