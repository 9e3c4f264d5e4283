"""The driver's tables in the shapes the jobs read.

Each shape is one SELECT in the dialect Spark and DuckDB share, so that a query
and its check start from the same rows. Blanks, dashes and unreadable values are
put in by key, since the driver's tables hold none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _amount_text(t: str) -> str:
    """Plain decimal text with a thousands comma."""
    return f"CASE WHEN length({t}) > 6 THEN substr({t}, 1, length({t}) - 6) || ',' || substr({t}, length({t}) - 5) ELSE {t} END"


def _slashed(d: str) -> str:
    return f"{_text(f'month({d})')} || '/' || {_text(f'day({d})')} || '/' || {_text(f'year({d})')}"


def _named(d: str) -> str:
    month = f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month({d}) AS INT) * 3 - 2, 3)"
    return (
        f"lpad({_text(f'day({d})')}, 2, '0') || '-' || {month} || '-' || "
        f"lpad({_text(f'year({d}) % 100')}, 2, '0')"
    )


SHAPES: dict[str, str] = {}

# invoice export rows: every value text, under ledger names, line_no as file order
SHAPES["raw_invoices"] = f"""
SELECT
  k AS line_no,
  CASE WHEN k % 211 = 0 THEN '-' WHEN k % 223 = 0 THEN '' WHEN k % 50 = 1 THEN {_text('k - 1')}
       ELSE {_text('k')} END AS transaction_id,
  CASE WHEN k % 13 = 0 THEN '-' WHEN o_orderstatus = 'F' THEN 'Paid' WHEN o_orderstatus = 'O' THEN ' open '
       WHEN k % 4 = 0 THEN 'WAIVED ' ELSE 'Void' END AS status,
  {_text('d')} AS date_created,
  CASE WHEN k % 29 = 0 THEN '' WHEN k % 31 = 0 THEN '-' WHEN k % 37 = 0 THEN 'soon'
       WHEN k % 3 = 0 THEN {_text('due')} WHEN k % 3 = 1 THEN {_slashed('due')} ELSE {_named('due')} END AS due_date,
  CASE WHEN o_orderstatus = 'F' THEN {_slashed('paid')} ELSE '-' END AS date_paid,
  CASE WHEN k % 17 = 0 THEN ' Other ' WHEN k % 2 = 0 THEN 'Income / One Time'
       ELSE 'income / Recurring Monthly ' END AS type,
  CASE substr(o_orderpriority, 1, 1)
    WHEN '1' THEN CASE k % 3 WHEN 0 THEN 'Rent' WHEN 1 THEN 'Rent / Prorated rent' ELSE 'rent / Rent' END
    WHEN '2' THEN CASE k % 3 WHEN 0 THEN 'Tenant charges & fees / Water fee'
                  WHEN 1 THEN 'Tenant Charges & Fees / gas fee' ELSE 'Tenant charges & fees / Late fee' END
    WHEN '3' THEN 'Tenant charges & fees / Pet charge'
    WHEN '4' THEN 'Deposit / Security'
    ELSE CASE k % 2 WHEN 0 THEN 'Credits' ELSE '-' END END AS transaction_category,
  CASE WHEN k % 43 = 0 THEN '-' WHEN k % 47 = 0 THEN 'abc' ELSE '$' || {_amount_text('t')} END AS original_amount,
  CASE WHEN o_orderstatus = 'F' THEN {_amount_text('t')} ELSE '' END AS payment,
  CASE WHEN o_orderstatus = 'F' THEN '0.00' ELSE '$ ' || {_amount_text('t')} END AS balance,
  CASE k % 6 WHEN 0 THEN 'ACH, ACH' WHEN 1 THEN 'Cash' WHEN 2 THEN 'ACH, Cash' WHEN 3 THEN 'cash , Cash,'
       WHEN 4 THEN '-' ELSE 'ACH,' END AS method_of_payment,
  CASE WHEN k % 41 = 0 THEN '-' WHEN k % 2 = 0 THEN c_name ELSE c_name || ' and co' END AS payer,
  CASE WHEN k % 2 = 0 THEN 'c' || {_text('c_custkey')} || '@example.com' ELSE '' END AS payer_email,
  CASE WHEN k % 499 = 0 THEN 'L-7' WHEN k % 53 = 0 THEN '-' ELSE {_text('c_custkey + 1')} END AS leasenum,
  CASE WHEN k % 59 = 0 THEN '' WHEN k % 61 = 0 THEN 'Nowhere' WHEN k % 2 = 0 THEN 'nation_' || {_text('c_nationkey')}
       ELSE ' NATION_' || {_text('c_nationkey')} END AS property,
  CASE WHEN k % 67 = 0 THEN 'no such unit' WHEN k % 71 = 0 THEN '-' WHEN k % 2 = 0 THEN lower(c_name)
       ELSE c_name END AS unit,
  CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'Security Deposit Applied to balance' WHEN 2 THEN 'TELLER deposit at PNC'
       WHEN 3 THEN 'paid by Certified Check' WHEN 4 THEN 'deposit applied, teller' WHEN 5 THEN '-'
       ELSE 'monthly' END AS transaction_details
FROM (
  SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL '30' DAY AS DATE) AS due,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL '45' DAY AS DATE) AS paid,
    CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS t
  FROM {{orders}}
) o JOIN {{customer}} c ON o_custkey = c_custkey
"""

_INCOME_TAIL = """
  CAST(o_totalprice AS DECIMAL(10,2)) AS original_amount,
  CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS DECIMAL(10,2)) AS payment,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS DECIMAL(10,2)) AS balance,
"""

# a typed ledger; line_no is its file order
SHAPES["ledger"] = f"""
SELECT
  k AS line_no,
  CASE WHEN k % 50 = 1 THEN {_text('k - 1')} ELSE {_text('k')} END AS transaction_id,
  CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Open' ELSE 'Void' END AS status,
  d AS date_created, d AS due_date,
  CASE WHEN o_orderstatus = 'F' THEN CAST(d + INTERVAL '5' DAY AS DATE) END AS date_paid,
  CASE k % 2 WHEN 0 THEN 'One Time' ELSE 'Recurring Monthly' END AS type,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Rent' WHEN '2' THEN 'Water fee' WHEN '3' THEN 'Pet Rent'
    WHEN '4' THEN 'Security' ELSE 'Credits' END AS transaction_category,
  CAST(NULL AS STRING) AS rent_month,
  {_INCOME_TAIL}
  CAST(NULL AS DECIMAL(10,2)) AS vacancy,
  CASE k % 3 WHEN 0 THEN 'ACH' WHEN 1 THEN 'Cash' ELSE 'ACH, Cash' END AS method_of_payment,
  CAST(CASE WHEN k % 41 = 0 THEN NULL ELSE o_custkey + 1 END AS BIGINT) AS payer,
  CAST(CASE WHEN k % 53 = 0 THEN NULL ELSE o_custkey + 1 END AS BIGINT) AS leasenum,
  CAST(c_nationkey + 1 AS BIGINT) AS property,
  CAST(CASE WHEN k % 97 = 0 THEN NULL ELSE o_custkey + 1 END AS BIGINT) AS unit,
  CAST(NULL AS STRING) AS transaction_details, '' AS exclude_zaky, '' AS sd_applied,
  CAST(year(d) AS INT) AS year
FROM (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM {{orders}}) o
JOIN {{customer}} c ON o_custkey = c_custkey
"""

# the same ledger in which low-priority rows are vacancy rows of an earlier run
SHAPES["ledger_with_vacancies"] = f"""
SELECT
  k AS line_no,
  CASE WHEN low THEN {_text('year(d)')} || '-Vacant-' || {_text('k')} ELSE {_text('k')} END AS transaction_id,
  CASE WHEN low THEN 'Vacancy' ELSE CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Open' ELSE 'Void' END
    END AS status,
  CASE WHEN low THEN make_date(CAST(year(d) AS INT), CAST(month(d) AS INT), 1) ELSE d END AS date_created,
  CASE WHEN low THEN make_date(CAST(year(d) AS INT), CAST(month(d) AS INT), 1) ELSE d END AS due_date,
  CAST(NULL AS DATE) AS date_paid,
  CASE WHEN low THEN 'Income' ELSE 'One Time' END AS type,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Rent' WHEN '2' THEN 'Water fee' WHEN '3' THEN 'Pet Rent'
    WHEN '4' THEN 'Security' ELSE 'Rent' END AS transaction_category,
  CAST(NULL AS STRING) AS rent_month,
  {_INCOME_TAIL}
  CAST(CASE WHEN low THEN o_totalprice END AS DECIMAL(10,2)) AS vacancy,
  CAST(NULL AS STRING) AS method_of_payment, CAST(NULL AS BIGINT) AS payer, CAST(NULL AS BIGINT) AS leasenum,
  CAST(c_nationkey + 1 AS BIGINT) AS property, CAST(o_custkey + 1 AS BIGINT) AS unit,
  CAST(NULL AS STRING) AS transaction_details, CAST(NULL AS STRING) AS exclude_zaky,
  CAST(NULL AS STRING) AS sd_applied, CAST(year(d) AS INT) AS year
FROM (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, substr(o_orderpriority, 1, 1) = '5' AS low
      FROM {{orders}}) o
JOIN {{customer}} c ON o_custkey = c_custkey
"""

# settled orders as the stored ledger, each under the year its due date falls in
SHAPES["stored_ledger"] = f"""
SELECT
  {_text('k')} AS transaction_id, 'Paid' AS status, d AS date_created, due AS due_date, due AS date_paid,
  'Income' AS type, 'Rent' AS transaction_category, CAST(NULL AS STRING) AS rent_month,
  {_INCOME_TAIL}
  CAST(NULL AS DECIMAL(10,2)) AS vacancy, 'stored' AS method_of_payment, CAST(NULL AS BIGINT) AS payer,
  CAST(NULL AS BIGINT) AS leasenum, CAST(NULL AS BIGINT) AS property, CAST(NULL AS BIGINT) AS unit,
  CAST(NULL AS STRING) AS transaction_details, '' AS exclude_zaky, '' AS sd_applied,
  CAST(year(due) AS INT) AS year
FROM (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d,
        CAST(CAST(o_orderdate AS DATE) + INTERVAL '30' DAY AS DATE) AS due FROM {{orders}}) o
WHERE o_orderstatus = 'F'
"""

SHAPES["property"] = f"""
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, 'Region ' || {_text('n_regionkey')} AS full_address,
  CAST(n_nationkey + 1 AS INT) AS number_of_units,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL
       ELSE make_date(CAST(1995 + n_nationkey % 7 AS INT), CAST(1 + n_nationkey % 12 AS INT), 15) END AS acquired_date
FROM {{nation}}
"""

SHAPES["units"] = """
SELECT CAST(c_custkey + 1 AS BIGINT) AS id, c_name AS name, CAST(c_nationkey + 1 AS BIGINT) AS property,
  CAST(c_custkey % 4 AS INT) AS bedrooms, 1 AS bathrooms, 'N' AS has_porch, 'N' AS has_back_yard,
  'Y' AS washer_dryer, CAST(NULL AS STRING) AS is_unit_group, CAST(NULL AS INT) AS group_reference
FROM {customer}
"""

SHAPES["tenant"] = f"""
SELECT CAST(c_custkey + 1 AS BIGINT) AS tenant_id, c_name AS name,
  CASE WHEN c_acctbal < 0 THEN '' ELSE 'c' || {_text('c_custkey - c_custkey % 3')} || '@example.com' END AS email,
  '' AS phone
FROM {{customer}}
"""

# tenants known before an invoice load
SHAPES["known_tenant"] = f"""
SELECT CAST(c_custkey + 1 AS BIGINT) AS tenant_id, c_name AS name,
  'c' || {_text('c_custkey')} || '@example.com' AS email, '' AS phone
FROM {{customer}} WHERE c_mktsegment = 'BUILDING'
"""

SHAPES["lease"] = """
SELECT CAST(c_custkey + 1 AS BIGINT) AS lease_number, CAST(c_nationkey + 1 AS BIGINT) AS property,
  CAST(c_custkey + 1 AS BIGINT) AS unit, CAST(NULL AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date,
  CAST(1995 AS INT) AS year
FROM {customer} WHERE c_mktsegment <> 'MACHINERY'
"""

# bank export rows: every value text; the line columns give the file order
SHAPES["raw_bank"] = f"""
SELECT
  l_orderkey AS line_order, l_linenumber AS line_item, l_partkey AS line_part, l_suppkey AS line_source, d AS line_day,
  '/in/Bank' || {_text('l_suppkey % 7')} || '_' || lpad({_text('l_suppkey % 100')}, 4, '0') || '_ALL_x.csv'
    AS source_file,
  CASE WHEN l_returnflag = 'N' THEN 'CREDIT' WHEN l_linenumber = 2 THEN ' debit' ELSE 'DEBIT' END AS details,
  CASE WHEN l_partkey % 83 = 0 THEN '' WHEN l_partkey % 89 = 0 THEN '2/30/' || {_text('year(d)')}
       ELSE {_slashed('d')} END AS posting_date,
  CASE WHEN l_linenumber = 1 THEN 'Orig Co Name:' ELSE 'ORIG CO NAME:' END || 'Supplier#'
    || lpad({_text('l_suppkey')}, 9, '0') || '       ORIG ID:' || {_text('l_orderkey % 10')} || ' DESC:pay, "x"'
    || CASE l_linenumber WHEN 7 THEN '' WHEN 6 THEN ' TRN:' WHEN 5 THEN ' trn:' || {_text('l_partkey')} || ' tail'
       WHEN 4 THEN ' TRN: ' || {_text('l_partkey')} ELSE ' TRN:' || {_text('l_partkey')} END AS description,
  CASE WHEN l_partkey % 79 = 0 THEN 'n/a' WHEN l_orderkey % 2 = 0 THEN '-' || {_amount_text('t')}
       ELSE {_amount_text('t')} END AS amount,
  CASE WHEN l_returnflag = 'N' THEN 'ACH_CREDIT' ELSE 'ACH_DEBIT' END AS type,
  '0.00' AS balance,
  CASE WHEN l_linenumber = 3 THEN {_text('l_partkey')} ELSE '' END AS check_or_slip
FROM (SELECT *, CAST(l_shipdate AS DATE) AS d, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) AS t
      FROM {{lineitem}}) l
"""

SHAPES["manifest"] = f"""
SELECT DISTINCT CAST(s_suppkey % 7 * 100 + s_suppkey % 100 + 1 AS BIGINT) AS id,
  '/in/Bank' || {_text('s_suppkey % 7')} || '_' || lpad({_text('s_suppkey % 100')}, 4, '0') || '_ALL_x.csv'
    AS file_path,
  CAST(NULL AS TIMESTAMP) AS processed_at, CAST(1998 AS INT) AS year, 'bank_transactions_raw' AS file_type,
  CAST(NULL AS BIGINT) AS total_rows, CAST(NULL AS BIGINT) AS success_rows, CAST(NULL AS BIGINT) AS failed_rows
FROM {{supplier}}
"""

# the manifest as it stood when only some banks had been loaded
SHAPES["earlier_manifest"] = f"""
SELECT * FROM ({SHAPES['manifest']}) m WHERE file_path < '/in/Bank4'
"""

SHAPES["expense_category"] = """
SELECT CAST(p_partkey AS BIGINT) AS category_id, p_name || ' ' || p_type AS category_name FROM {part}
"""

SHAPES["provider"] = """
SELECT CAST(s_suppkey AS BIGINT) AS provider_id, s_name AS provider_name,
  'Nation ' || CAST(s_nationkey AS STRING) AS provider_address, CAST(NULL AS STRING) AS email,
  CAST(NULL AS STRING) AS phone, 'firm' AS entity
FROM {supplier}
"""

SHAPES["expense"] = f"""
SELECT {_text('l_orderkey')} || '-' || {_text('l_linenumber')} || '-' || {_text('l_partkey')} || '-'
    || {_text('l_suppkey')} AS transaction,
  CAST(l_shipdate AS DATE) AS date, CAST(year(l_shipdate) AS INT) AS year,
  CAST(l_extendedprice AS DECIMAL(10,2)) AS amount, CAST(NULL AS STRING) AS details, 'ACH' AS payment_mode,
  CAST(NULL AS STRING) AS check_num, 'Bank-1' AS payment_account,
  CAST(l_suppkey % 30 + 1 AS BIGINT) AS property, CAST(l_orderkey AS BIGINT) AS unit,
  CAST(l_partkey AS BIGINT) AS category, CAST(l_suppkey AS BIGINT) AS provider,
  'Operation' AS type, 'N' AS exclude, 'N' AS exclude_zaky
FROM {{lineitem}}
"""

SHAPES["messages"] = f"""
SELECT event_id AS message_number, 'Your ' || event_type || ' notice ' || {_text('event_id % 100')} AS subject,
  'User' || {_text('user_id')} || '@example.com' AS sender, ts AS received_date,
  'value ' || props AS body, event_type = 'view' AS is_read, event_type AS kind
FROM {{events}}
"""

SHAPES["parts"] = f"""
SELECT conv_id AS message_number, turn AS part_no,
  CASE role WHEN 'user' THEN 'text/plain; charset=utf-8' WHEN 'assistant' THEN 'TEXT/html' ELSE 'image/png' END
    AS mime_type,
  CASE role WHEN 'assistant' THEN '<p>' || text || '</p><br/>&amp;<b>x</b>' ELSE text END AS content,
  CASE WHEN role = 'system' THEN 'inline' WHEN turn % 3 = 1 THEN 'ATTACHMENT' ELSE 'attachment ' END AS disposition,
  'file_' || {_text('turn')} || '.pdf' AS file_name,
  conv_id % 10 <> 0 AS multipart
FROM {{conversations}}
"""

SHAPES["recipients"] = f"""
SELECT event_id AS message_number, CAST(event_id % 3 AS INT) AS place, CASE WHEN event_id % 5 = 0 THEN 'Cc' ELSE 'To' END AS kind,
  'user' || {_text('user_id')} || '@example.com' AS address FROM {{events}}
UNION ALL
SELECT event_id, 3, CASE WHEN event_id % 7 = 0 THEN 'bcc' ELSE 'to ' END, 'office@example.com' FROM {{events}}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SHAPES[name]
    tables = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **tables)


def shape_sql(name: str) -> str:
    """The shape over views named like the tables."""
    sql = SHAPES[name]
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
