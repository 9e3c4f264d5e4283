"""Invoice exports to the income ledger, with its tenants and leases."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rentroll.functions import parse, text
from rentroll.operators.lookup import collect_members, latest_by_email, resolve_property, resolve_unit
from rentroll.operators.mutate import GuardedUpsert, guarded_upsert, require_no_conflicts
from rentroll.operators.quality import year_column
from rentroll.operators.sequence import surrogate_keys
from rentroll.schemas import INCOME, LEASE, LEASE_TENANT, TENANT, conform
from rentroll.session import durable
from rentroll.sources.csv import LINE_COLUMNS


def _optional(name: str, df: DataFrame) -> Column:
    return text.clean_optional(F.col(name)) if name in df.columns else F.lit(None).cast("string")


INVOICE_TEXTS = (
    "transaction_id", "status", "type", "transaction_category", "method_of_payment", "transaction_details",
)


def normalize_invoices(raw: DataFrame) -> DataFrame:
    """Drop voided rows and credits; clean text, categories, methods and flags.

    Columns the step does not know are carried along; a text column that is not there is NULL.
    """
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in INVOICE_TEXTS if c not in raw.columns})
    kept = raw.filter(text.kept_invoice(F.col("status"), F.col("transaction_category")))
    # in steps, so that each text is cleaned once however often later rules look at it
    clean = kept.withColumns(
        {
            "transaction_id": text.clean_token(F.col("transaction_id")),
            "status": F.coalesce(text.clean_token(F.col("status")), F.lit("")),
            "type": text.normalize_type(text.clean_token(F.col("type"))),
            "transaction_category": F.coalesce(text.clean_token(F.col("transaction_category")), F.lit("")),
            "method_of_payment": text.clean_token(F.col("method_of_payment")),
            "transaction_details": text.clean_optional(F.col("transaction_details")),
            "payer": _optional("payer", raw),
            "payer_email": _optional("payer_email", raw),
            "property_name": _optional("property", raw),
            "unit_name": _optional("unit", raw),
        }
    )
    category, group, rest = (F.col(c) for c in ("transaction_category", "_group", "_rest"))
    split = clean.withColumn("_group", text.category_group(category))
    split = split.withColumn("_rest", text.category_rest(category, group))
    details = F.col("transaction_details")
    ruled = split.withColumns(
        {
            "transaction_category": text.grouped_category(category, group, rest),
            "type": text.grouped_type(F.col("type"), group, rest),
            "method_of_payment": text.override_method(text.collapse_method(F.col("method_of_payment")), details),
        }
    ).drop("_group", "_rest")
    exclude, applied = text.ledger_flags(F.col("method_of_payment"), details)
    return ruled.withColumns({"exclude_zaky": exclude, "sd_applied": applied})


def parse_invoices(rows: DataFrame, lenient_dates: bool = False) -> DataFrame:
    """Dates, money, lease numbers and the rent month."""

    texts = ["due_date", "date_created", "date_paid", "original_amount", "payment", "balance", "vacancy", "leasenum"]
    clean = rows.withColumns({c: _optional(c, rows) for c in texts})

    def date(name: str) -> Column:
        return parse.parse_date(F.col(name), lenient_dates)

    lease = F.col("leasenum")
    parsed = clean.withColumns(
        {
            "due_date": date("due_date"),
            "date_created": date("date_created"),
            "date_paid": date("date_paid"),
            "original_amount": parse.parse_money(F.col("original_amount")),
            "payment": parse.parse_money(F.col("payment")),
            "balance": parse.parse_money(F.col("balance")),
            "vacancy": parse.parse_money(F.col("vacancy")),
            "leasenum": parse.zero_to_null(parse.parse_whole(lease)),
            "_bad_lease": lease.isNotNull() & parse.parse_whole(lease).isNull(),
        }
    )
    rent = text.one_of_ci(F.col("transaction_category"), text.RENT_CATEGORIES)
    return parsed.withColumn(
        "rent_month",
        F.when(rent, parse.rent_month(F.col("due_date"))).otherwise(_optional("rent_month", rows)),
    )


def reject_reason() -> Column:
    """Why a parsed row cannot enter the ledger; NULL when it can."""
    return F.when(
        F.col("transaction_id").isNull() | (F.col("transaction_id") == ""), F.lit("missing transaction id")
    ).when(F.col("_bad_lease"), F.lit("lease number is not a whole number"))


def _tenant_key() -> Column:
    """Tenants are told apart by email, or by name where there is none."""
    return F.when(
        F.col("payer").isNotNull(),
        F.coalesce(F.concat(F.lit("e:"), F.col("payer_email")), F.concat(F.lit("n:"), F.col("payer"))),
    )


class Tenants(NamedTuple):
    tenants: DataFrame  # stored and new members
    keyed: DataFrame  # tenant_key -> tenant_id for the rows of this batch


def resolve_tenants(rows: DataFrame, existing: DataFrame, order_by: Sequence[str]) -> Tenants:
    """Match payers to stored tenants by email; the others become tenants in order of appearance."""
    paying = rows.withColumn("tenant_key", _tenant_key()).filter(F.col("tenant_key").isNotNull())
    order = F.struct(*[F.col(c) for c in order_by])
    batch = paying.groupBy("tenant_key").agg(
        F.min(order).alias("_first"),
        F.min_by(F.struct("payer", "payer_email"), order).alias("_who"),
    )
    stored = latest_by_email(existing).select(
        F.concat(F.lit("e:"), F.col("email")).alias("tenant_key"), "tenant_id"
    )
    new = batch.join(stored, "tenant_key", "left_anti").select(
        "tenant_key",
        F.col("_who.payer").alias("name"),
        F.col("_who.payer_email").alias("email"),
        F.lit("").alias("phone"),
        *[F.col(f"_first.{c}").alias(f"_first_{c}") for c in order_by],
    )
    numbered = surrogate_keys(new, [f"_first_{c}" for c in order_by], existing, "tenant_id")
    tenants = existing.unionByName(conform(numbered, TENANT.schema))
    matched = batch.select("tenant_key").join(stored, "tenant_key")
    return Tenants(tenants, matched.unionByName(numbered.select("tenant_key", "tenant_id")))


class Leases(NamedTuple):
    leases: DataFrame
    links: DataFrame


def resolve_leases(
    rows: DataFrame, existing: DataFrame, links: DataFrame, order_by: Sequence[str]
) -> Leases:
    """New leases take the property and unit of their first row; every lease links all its tenants.

    ``rows`` are resolved ledger rows. Only rows with a payer found or make leases.
    """
    leased = rows.filter(F.col("tenant_id").isNotNull() & F.col("leasenum").isNotNull())
    order = F.struct(*[F.col(c) for c in order_by])
    first = (
        leased.groupBy(F.col("leasenum").alias("lease_number"))
        .agg(F.min_by(F.struct("property", "unit", "year"), order).alias("_row"))
        .select("lease_number", "_row.*")
    )
    new = first.join(existing.select("lease_number"), "lease_number", "left_anti")
    pairs = leased.select(F.col("leasenum").alias("lease_id"), "tenant_id").distinct()
    fresh = pairs.join(links, ["lease_id", "tenant_id"], "left_anti")
    return Leases(
        existing.unionByName(conform(new, LEASE.schema)),
        links.unionByName(conform(fresh, LEASE_TENANT.schema)),
    )


def leases_with_tenants(leases: DataFrame, links: DataFrame, page_size: int = 10_000) -> DataFrame:
    """Leases with the sorted list of their tenants, a row for each page of ``page_size`` of them.

    Segment 0 is there for every lease, with an empty list where there are no tenants.
    """
    lists = collect_members(links, "lease_id", "tenant_id", "tenants", page_size).withColumnRenamed("lease_id", "lease_number")
    none = F.array().cast("array<bigint>")
    joined = leases.join(lists, "lease_number", "left")
    return joined.withColumns(
        {"segment": F.coalesce("segment", F.lit(0)), "tenants": F.coalesce("tenants", none)}
    ).select(*leases.columns, "segment", "tenants")


def lease_summaries(with_tenants: DataFrame) -> DataFrame:
    """Each lease as one struct."""
    return with_tenants.select("lease_number", F.struct(*with_tenants.columns).alias("summary"))


def tenant_maps(tenants: DataFrame) -> DataFrame:
    """Each tenant as a map of its fields."""
    fields = [x for c in TENANT.schema.names for x in (F.lit(c), F.col(c).cast("string"))]
    return tenants.select("tenant_id", F.create_map(*fields).alias("fields"))


class LedgerBuild(NamedTuple):
    ledger: DataFrame
    actions: DataFrame
    rejects: DataFrame
    tenants: DataFrame
    leases: DataFrame
    lease_tenants: DataFrame


def build_income_ledger(
    raw: DataFrame,
    properties: DataFrame,
    units: DataFrame,
    income: DataFrame,
    tenants: DataFrame,
    leases: DataFrame,
    lease_tenants: DataFrame,
    year: Column | int,
    order_by: Sequence[str] = LINE_COLUMNS,
    overwrite: bool = False,
    lenient_dates: bool = False,
    on_conflict: str = "raise",
    settle: bool = False,
) -> LedgerBuild:
    """Raw invoice rows (ledger names, all text) to complete new table states.

    ``year`` is the processing year; an expression lets one run hold many years.
    Rows without an id or a year, or with an unreadable lease number, come back as rejects. A row whose key is
    stored under another year stops the run; with ``on_conflict="report"`` it is left out and listed in the actions.
    ``settle`` stores the resolved rows, for callers that use several of the tables: else each table resolves them anew.
    """
    parsed = parse_invoices(normalize_invoices(raw), lenient_dates).withColumn("year", year_column(year))
    # parsed once: the tenant, lease and ledger steps each read only the columns they need
    reasoned = durable(
        parsed.withColumn("reason", F.coalesce(reject_reason(), F.when(F.col("year").isNull(), F.lit("missing year")))), "invoices")
    rejects = reasoned.filter(F.col("reason").isNotNull()).select("transaction_id", "reason", *order_by)
    good = reasoned.filter(F.col("reason").isNull()).drop("reason", "_bad_lease", "property", "unit")
    placed = resolve_unit(resolve_property(good, properties, "property_name"), units, "unit_name")

    who = resolve_tenants(good, tenants, order_by)
    keyed = placed.withColumn("tenant_key", _tenant_key()).join(who.keyed, "tenant_key", "left")
    if settle:
        keyed = durable(keyed, "resolved")
    lets = resolve_leases(keyed, leases, lease_tenants, order_by)

    rows = conform(keyed.drop("payer").withColumnRenamed("tenant_id", "payer"), INCOME.schema, keep_extra=True)
    result: GuardedUpsert = guarded_upsert(income, rows, "transaction_id", "year", order_by, overwrite, settle)
    if on_conflict == "raise":
        require_no_conflicts(result.actions)
    return LedgerBuild(result.table, result.actions, rejects, who.tenants, lets.leases, lets.links)
