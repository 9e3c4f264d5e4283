"""Declared tables: columns, keys, references and text lengths, and schema conforming."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

MONEY = "decimal(10,2)"


@dataclass(frozen=True)
class Table:
    name: str
    ddl: str
    key: tuple[str, ...]
    # column -> (parent table, parent key column)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @property
    def names(self) -> list[str]:
        """Column names; unlike ``schema`` this needs no running session."""
        return [column.split()[0].strip("`") for column in self.ddl.split(", ")]


PROPERTY = Table(
    "property",
    "id BIGINT, name STRING, full_address STRING, number_of_units INT, acquired_date DATE",
    key=("id",),
    lengths={"name": 100, "full_address": 255},
)
UNITS = Table(
    "units",
    "id BIGINT, name STRING, property BIGINT, bedrooms INT, bathrooms INT, has_porch STRING, "
    "has_back_yard STRING, washer_dryer STRING, is_unit_group STRING, group_reference INT",
    key=("id",),
    references={"property": ("property", "id")},
    lengths={"name": 10, "has_porch": 1, "has_back_yard": 1, "washer_dryer": 1, "is_unit_group": 1},
)
TENANT = Table(
    "tenant",
    "tenant_id BIGINT, name STRING, email STRING, phone STRING",
    key=("tenant_id",),
    lengths={"name": 100, "email": 100, "phone": 15},
)
LEASE = Table(
    "lease",
    "lease_number BIGINT, property BIGINT, unit BIGINT, start_date DATE, end_date DATE, year INT",
    key=("lease_number",),
    references={"property": ("property", "id"), "unit": ("units", "id")},
)
LEASE_TENANT = Table(
    "lease_tenant",
    "lease_id BIGINT, tenant_id BIGINT",
    key=("lease_id", "tenant_id"),
    references={"lease_id": ("lease", "lease_number"), "tenant_id": ("tenant", "tenant_id")},
)
EXPENSE_CATEGORY = Table(
    "expense_category",
    "category_id BIGINT, category_name STRING",
    key=("category_id",),
    unique=("category_name",),
    lengths={"category_name": 25},
)
PROVIDER = Table(
    "provider",
    "provider_id BIGINT, provider_name STRING, provider_address STRING, email STRING, phone STRING, entity STRING",
    key=("provider_id",),
    lengths={"provider_name": 50, "provider_address": 255, "email": 100, "phone": 15, "entity": 255},
)
INCOME = Table(
    "income",
    "transaction_id STRING, status STRING, date_created DATE, due_date DATE, date_paid DATE, type STRING, "
    f"transaction_category STRING, rent_month STRING, original_amount {MONEY}, payment {MONEY}, balance {MONEY}, "
    f"vacancy {MONEY}, method_of_payment STRING, payer BIGINT, leasenum BIGINT, property BIGINT, unit BIGINT, "
    "transaction_details STRING, exclude_zaky STRING, sd_applied STRING, year INT",
    key=("transaction_id",),
    references={
        "payer": ("tenant", "tenant_id"),
        "leasenum": ("lease", "lease_number"),
        "property": ("property", "id"),
        "unit": ("units", "id"),
    },
    lengths={
        "transaction_id": 32, "status": 10, "type": 255, "transaction_category": 255, "rent_month": 10,
        "method_of_payment": 255, "transaction_details": 255, "exclude_zaky": 1, "sd_applied": 1,
    },
)
EXPENSE = Table(
    "expense",
    f"transaction STRING, date DATE, year INT, amount {MONEY}, details STRING, payment_mode STRING, "
    "check_num STRING, payment_account STRING, property BIGINT, unit BIGINT, category BIGINT, provider BIGINT, "
    "type STRING, exclude STRING, exclude_zaky STRING",
    key=("transaction",),
    references={
        "property": ("property", "id"),
        "unit": ("units", "id"),
        "category": ("expense_category", "category_id"),
        "provider": ("provider", "provider_id"),
    },
    lengths={
        "transaction": 50, "details": 255, "payment_mode": 255, "check_num": 10, "payment_account": 255,
        "type": 255, "exclude": 1, "exclude_zaky": 1,
    },
)
MAINTENANCE_REQUEST = Table(
    "maintenance_request",
    f"ticket_id STRING, property BIGINT, unit BIGINT, tenant BIGINT, amount {MONEY}, year INT",
    key=("ticket_id",),
    references={"property": ("property", "id"), "unit": ("units", "id"), "tenant": ("tenant", "tenant_id")},
    lengths={"ticket_id": 255},
)
BANK_PAYMENT = Table(
    "bank_payment",
    f"transaction_id STRING, date DATE, property BIGINT, bank STRING, total_amount {MONEY}, interest {MONEY}, "
    f"principal {MONEY}, year INT",
    key=("transaction_id",),
    references={"property": ("property", "id")},
    lengths={"transaction_id": 25, "bank": 255},
)
FILE_PROCESSING = Table(
    "file_processing",
    "id BIGINT, file_path STRING, processed_at TIMESTAMP, year INT, file_type STRING, total_rows BIGINT, "
    "success_rows BIGINT, failed_rows BIGINT",
    key=("id",),
    unique=("file_path",),
    lengths={"file_path": 512, "file_type": 64},
)
STAGING = Table(
    "bank_transaction_staging",
    f"id BIGINT, file_id BIGINT, details STRING, posting_date DATE, description STRING, amount {MONEY}, "
    "type STRING, check_num STRING, year INT, is_processed STRING",
    key=("id",),
    references={"file_id": ("file_processing", "id")},
    lengths={"details": 10, "description": 400, "type": 20, "check_num": 40, "is_processed": 1},
)
MESSAGE = Table(
    "message",
    "message_number BIGINT, subject STRING, `from` STRING, `to` ARRAY<STRING>, received_date TIMESTAMP, "
    "sent_date TIMESTAMP, body STRING, attachments ARRAY<STRING>, `read` BOOLEAN",
    key=("message_number",),
)

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        PROPERTY, UNITS, TENANT, LEASE, LEASE_TENANT, EXPENSE_CATEGORY, PROVIDER, INCOME, EXPENSE,
        MAINTENANCE_REQUEST, BANK_PAYMENT, FILE_PROCESSING, STAGING, MESSAGE,
    )
}


def conform(df: DataFrame, schema: StructType, keep_extra: bool = False) -> DataFrame:
    """Cast and reorder to ``schema``; columns the input lacks become typed NULLs.

    With ``keep_extra`` the input's further columns follow the declared ones.
    """
    present = {c.lower() for c in df.columns}
    cols = [
        (F.col(f"`{f.name}`") if f.name.lower() in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    if keep_extra:
        declared = {n.lower() for n in schema.names}
        cols += [F.col(f"`{c}`") for c in df.columns if c.lower() not in declared]
    return df.select(*cols)
