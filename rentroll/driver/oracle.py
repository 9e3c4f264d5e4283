"""The registered queries as DuckDB SQL over the driver's tables."""

from __future__ import annotations

import re

from rentroll.driver.shapes import SHAPES, shape_sql
from rentroll.functions import markup
from rentroll.schemas import INCOME, PROVIDER, UNITS

# steps shared by several queries, on top of the shapes
STEPS: dict[str, str] = {}


def _opt(c: str) -> str:
    return f"CASE WHEN trim({c}) NOT IN ('', '-') THEN trim({c}) END"


def _tok(c: str) -> str:
    return f"CASE WHEN trim({c}) <> '-' THEN trim({c}) END"


def _money(c: str) -> str:
    return f"TRY_CAST(trim(replace(replace({c}, ',', ''), '$', '')) AS DECIMAL(10,2))"


def _date(c: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST({c} AS DATE) "
        f"WHEN regexp_full_match({c}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') "
        f"THEN TRY_CAST(try_strptime({c}, '%m/%d/%Y') AS DATE) "
        f"WHEN regexp_full_match({c}, '\\d{{1,2}}-[A-Za-z]{{3}}-\\d{{2}}') "
        f"THEN TRY_CAST(try_strptime({c}, '%d-%b-%y') AS DATE) END"
    )


def _month_name(due: str) -> str:
    return f"coalesce(strftime({due} + INTERVAL 5 DAY, '%B'), '')"


STEPS["kept"] = """
SELECT * EXCLUDE (line_no) FROM ledger
WHERE lower(status) NOT IN ('void', 'waived') AND lower(transaction_category) <> 'credits'
"""
STEPS["kept_vacancies"] = STEPS["kept"].replace("FROM ledger", "FROM ledger_with_vacancies")


def _vacancy_steps(src: str, acquired: bool, continued: bool) -> str:
    start = "1"
    if acquired:
        start = (
            "CASE WHEN p.acquired_date IS NULL OR year(p.acquired_date) < u.year THEN 1 "
            "WHEN year(p.acquired_date) > u.year THEN 13 ELSE month(p.acquired_date) + 2 END"
        )
    last = "0"
    if continued:
        last = (
            f"coalesce((SELECT max(CAST(regexp_extract(transaction_id, '-Vacant-(\\d+)$', 1) AS BIGINT)) FROM {src} x "
            "WHERE x.transaction_id LIKE CAST(g.year AS VARCHAR) || '-Vacant-%'), 0)"
        )
    return f"""
rent_units AS (
  SELECT year, property, unit, min(original_amount) AS base_rent FROM {src}
  WHERE transaction_category = 'Rent' AND property IS NOT NULL AND unit IS NOT NULL
  GROUP BY ALL HAVING min(original_amount) IS NOT NULL),
present AS (SELECT DISTINCT year, property, unit, month(due_date) AS m FROM {src} WHERE transaction_category = 'Rent'),
grid AS (
  SELECT u.*, CAST(m.m AS INTEGER) AS m FROM rent_units u CROSS JOIN range(1, 13) m(m)
  LEFT JOIN property p ON p.id = u.property WHERE m.m >= {start}),
gaps AS (SELECT * FROM grid g ANTI JOIN present USING (year, property, unit, m)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY property, unit, m) AS rn FROM gaps),
lasts AS (SELECT g.year, {last} AS last_no FROM (SELECT DISTINCT year FROM gaps) g),
vacancies AS (
  SELECT CAST(n.year AS VARCHAR) || '-Vacant-' || CAST(rn + last_no AS VARCHAR) AS transaction_id,
    'Vacancy' AS status, make_date(n.year, m, 1) AS date_created, make_date(n.year, m, 1) AS due_date,
    CAST(NULL AS DATE) AS date_paid, 'Income' AS type, 'Rent' AS transaction_category,
    {_month_name('make_date(n.year, m, 1)')} AS rent_month, base_rent AS original_amount,
    CAST(NULL AS DECIMAL(10,2)) AS payment, CAST(NULL AS DECIMAL(10,2)) AS balance, base_rent AS vacancy,
    CAST(NULL AS VARCHAR) AS method_of_payment, CAST(NULL AS BIGINT) AS payer, CAST(NULL AS BIGINT) AS leasenum,
    property, unit, CAST(NULL AS VARCHAR) AS transaction_details, CAST(NULL AS VARCHAR) AS exclude_zaky,
    CAST(NULL AS VARCHAR) AS sd_applied, n.year
  FROM numbered n JOIN lasts ON lasts.year = n.year)"""


_DETAILS = "lower(coalesce(transaction_details, ''))"
_TELLER = f"({_DETAILS} LIKE '%teller%' OR {_DETAILS} LIKE '%pnc%' OR {_DETAILS} LIKE '%certified check%')"
_APPLIED = f"({_DETAILS} LIKE '%deposit applied%')"

STEPS["clean_invoices"] = f"""
SELECT line_no, {_tok('transaction_id')} AS transaction_id, coalesce({_tok('status')}, '') AS status,
  coalesce(CASE lower(trim(type)) WHEN 'income / recurring monthly' THEN 'Recurring Monthly'
    WHEN 'income / one time' THEN 'One Time' ELSE trim(type) END, '') AS type0,
  coalesce({_tok('transaction_category')}, '') AS cat0, {_opt('transaction_details')} AS transaction_details,
  coalesce({_tok('method_of_payment')}, '') AS method0,
  date_created, due_date, date_paid, original_amount, payment, balance,
  {_opt('payer')} AS payer, {_opt('payer_email')} AS payer_email, {_opt('leasenum')} AS leasenum,
  {_opt('property')} AS property_name, {_opt('unit')} AS unit_name
FROM raw_invoices
WHERE lower(trim(status)) NOT IN ('void', 'waived') AND lower(trim(transaction_category)) <> 'credits'
"""
STEPS["normalized"] = f"""
SELECT line_no, transaction_id, status,
  CASE WHEN lower(cat0) LIKE 'tenant charges & fees /%'
         AND lower(trim(substr(cat0, 24))) IN ('water fee', 'gas fee', 'electricity fee') THEN 'Reimbursement'
       WHEN lower(cat0) LIKE 'deposit /%' THEN 'Deposit' ELSE type0 END AS type,
  CASE WHEN lower(cat0) LIKE 'tenant charges & fees /%' THEN
         CASE WHEN lower(trim(substr(cat0, 24))) = 'pet charge' THEN 'Pet Rent' ELSE trim(substr(cat0, 24)) END
       WHEN lower(cat0) LIKE 'deposit /%' THEN trim(substr(cat0, 10))
       WHEN lower(cat0) LIKE 'rent /%' THEN trim(substr(cat0, 7)) ELSE cat0 END AS transaction_category,
  method_of_payment, transaction_details,
  CASE WHEN {_APPLIED} OR lower(trim(method_of_payment)) = 'cash' THEN 'Y' ELSE '' END AS exclude_zaky,
  CASE WHEN {_APPLIED} THEN 'Y' ELSE '' END AS sd_applied,
  payer, payer_email, property_name, unit_name,
  date_created, due_date, date_paid, original_amount, payment, balance, leasenum
FROM (
  SELECT *, CASE WHEN {_TELLER} THEN 'Teller Deposit' WHEN {_APPLIED} THEN 'Deposit Applied'
    WHEN len(parts) > 1 AND len(list_distinct(list_transform(parts, lambda x: lower(trim(x))))) = 1
    THEN trim(parts[1]) ELSE method0 END AS method_of_payment
  FROM (SELECT *, string_split(rtrim(method0, ','), ',') AS parts FROM clean_invoices))
"""
STEPS["parsed"] = f"""
SELECT *, CASE WHEN lower(transaction_category) IN ('rent', 'prorated rent', 'pet rent')
    THEN {_month_name('due')} END AS rent_month
FROM (
  SELECT line_no, transaction_id, status, type, transaction_category, method_of_payment, transaction_details,
    exclude_zaky, sd_applied, payer, payer_email, property_name, unit_name,
    {_date('trim(date_created)')} AS created, {_date('trim(due_date)')} AS due, {_date('trim(date_paid)')} AS paid,
    {_money('original_amount')} AS original_amount, {_money('payment')} AS payment, {_money('balance')} AS balance,
    nullif(TRY_CAST(leasenum AS BIGINT), 0) AS leasenum,
    leasenum IS NOT NULL AND TRY_CAST(leasenum AS BIGINT) IS NULL AS bad_lease
  FROM normalized)
"""
STEPS["good"] = """
SELECT *, CAST(year(created) AS INTEGER) AS year,
  CASE WHEN payer IS NOT NULL THEN coalesce('e:' || payer_email, 'n:' || payer) END AS tenant_key
FROM parsed WHERE coalesce(transaction_id, '') <> '' AND NOT bad_lease
"""
STEPS["placed"] = """
SELECT g.*, coalesce(p.id, 0) AS property, u.id AS unit
FROM good g
LEFT JOIN property p ON lower(p.name) = lower(g.property_name)
LEFT JOIN units u ON u.property = p.id AND lower(u.name) = lower(g.unit_name)
"""
STEPS["batch_tenants"] = """
SELECT tenant_key, min(line_no) AS first_line, arg_min(payer, line_no) AS name, min(payer_email) AS email
FROM good WHERE tenant_key IS NOT NULL GROUP BY tenant_key
"""
STEPS["new_tenants"] = """
SELECT b.*, (SELECT max(tenant_id) FROM known_tenant) + row_number() OVER (ORDER BY first_line) AS tenant_id
FROM batch_tenants b WHERE NOT EXISTS (SELECT 1 FROM known_tenant k WHERE 'e:' || k.email = b.tenant_key)
"""
STEPS["tenant_map"] = """
SELECT tenant_key, tenant_id FROM new_tenants
UNION ALL SELECT b.tenant_key, k.tenant_id FROM batch_tenants b JOIN known_tenant k ON 'e:' || k.email = b.tenant_key
"""
STEPS["keyed"] = "SELECT p.*, t.tenant_id FROM placed p LEFT JOIN tenant_map t USING (tenant_key)"
STEPS["built_ledger"] = """
SELECT transaction_id, status, created AS date_created, due AS due_date, paid AS date_paid, type,
  transaction_category, rent_month, original_amount, payment, balance, CAST(NULL AS DECIMAL(10,2)) AS vacancy,
  method_of_payment, tenant_id AS payer, leasenum, property, unit, transaction_details, exclude_zaky, sd_applied, year
FROM keyed QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY line_no) = 1
"""
STEPS["staged"] = """
SELECT line_order, line_item, line_part, line_source, line_day, source_file,
  nullif(trim(details), '') AS details,
  CASE WHEN regexp_full_match(trim(posting_date), '\\d{1,2}/\\d{1,2}/\\d{4}')
       THEN TRY_CAST(try_strptime(trim(posting_date), '%m/%d/%Y') AS DATE) END AS posting_date,
  nullif(trim(substr(description, 1, 400)), '') AS description,
  """ + _money("amount") + """ AS amount, nullif(trim(type), '') AS type,
  nullif(trim(check_or_slip), '') AS check_num, CAST(year(line_day) AS INTEGER) AS year
FROM raw_bank
"""
STEPS["judged"] = """
SELECT s.*, m.id AS file_id, m.file_path,
  CASE WHEN upper(details) = 'DEBIT' THEN
    CASE WHEN upper(description) LIKE 'ORIG CO NAME:SUPPLIER#000000001%' THEN 'ORIG CO NAME:SUPPLIER#000000001'
         WHEN upper(description) LIKE 'ORIG CO NAME:SUPPLIER#000000002%' THEN 'ORIG CO NAME:SUPPLIER#000000002'
         WHEN upper(description) LIKE 'ORIG CO NAME:SUPPLIER#000000003%' THEN 'ORIG CO NAME:SUPPLIER#000000003'
    END END AS lender,
  CASE WHEN line_source = 1 THEN
         CASE WHEN upper(description) LIKE '%ORIG ID:3 %' THEN 'NATION_3'
              WHEN upper(description) LIKE '%ORIG ID:4 %' THEN 'nation_4' END
       WHEN line_source = 2 THEN 'NATION_7' WHEN line_source = 3 THEN 'no such property' END AS property_name,
  nullif(regexp_extract(description, '(?i)(?:^|\\s)TRN:\\s*(\\S+)', 1), '') AS trn,
  upper(details) = 'DEBIT' AND upper(description) LIKE 'ORIG CO NAME:SUPPLIER#000000004%' AS utility
FROM staged s LEFT JOIN manifest m ON m.file_path = s.source_file
"""
STEPS["marked"] = """
SELECT *, CASE
    WHEN utility THEN CASE WHEN trn IS NULL OR posting_date IS NULL OR amount IS NULL THEN 'N' ELSE 'Y' END
    WHEN lender IS NOT NULL THEN CASE WHEN amount IS NULL THEN 'N' ELSE 'Y' END END AS is_processed,
  CASE WHEN utility THEN CASE WHEN trn IS NULL THEN 'missing trace number'
    WHEN posting_date IS NULL THEN 'missing date' WHEN amount IS NULL THEN 'missing amount' END END AS reject_reason
FROM judged
"""
_CONTENT = "details, posting_date, description, amount, type, check_num, year"
_LINE = "line_order, line_item, line_part, line_source, line_day"
STEPS["payments"] = f"""
SELECT CAST(j.year AS VARCHAR) || '-BANKPAY-' || CAST(row_number() OVER (PARTITION BY j.year ORDER BY {_LINE})
    AS VARCHAR) AS transaction_id,
  posting_date AS date, coalesce(p.id, 0) AS property,
  trim(regexp_extract(description, '(?is)ORIG CO NAME:(.*?)(?:ORIG ID:|$)', 1)) AS bank,
  amount AS total_amount, CAST(0 AS DECIMAL(10,2)) AS interest, CAST(0 AS DECIMAL(10,2)) AS principal, j.year
FROM judged j LEFT JOIN property p ON lower(p.name) = lower(j.property_name)
WHERE lender IS NOT NULL AND amount IS NOT NULL
"""
STEPS["utility_rows"] = f"""
SELECT 'SE-' || CAST(year AS VARCHAR) || '-' || trn AS transaction, posting_date AS date, year, amount,
  'Internet Service' AS details, type AS payment_mode, CAST(NULL AS VARCHAR) AS check_num,
  split_part(regexp_extract(file_path, '[^/]+$'), '_', 1) || '-' || split_part(regexp_extract(file_path, '[^/]+$'),
    '_', 2) AS payment_account,
  CAST(CASE WHEN amount > 50 THEN (SELECT id FROM property WHERE name = 'NATION_1')
       ELSE (SELECT id FROM property WHERE name = 'NATION_2') END AS BIGINT) AS property,
  CAST(NULL AS BIGINT) AS unit, (SELECT max(p_partkey) FROM part) AS category, CAST(4 AS BIGINT) AS provider,
  'Operation' AS type, 'N' AS exclude, 'N' AS exclude_zaky
FROM marked WHERE utility AND is_processed = 'Y'
QUALIFY row_number() OVER (PARTITION BY transaction ORDER BY line_order DESC, line_item DESC, line_part DESC,
  line_source DESC, line_day DESC) = 1
"""
STEPS["shipped_names"] = """
SELECT l_suppkey AS provider_id, 'Part ' || CAST(l_partkey AS VARCHAR) AS provider_name
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_shipdate DESC) = 1
"""
STEPS["known_provider"] = "SELECT * FROM provider WHERE provider_address < 'Nation 2'"
STEPS["first_ledger"] = "SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY line_no) = 1"
STEPS["last_ledger"] = (
    "SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY line_no DESC) = 1"
)
STEPS["links"] = """
SELECT DISTINCT leasenum AS lease_id, payer AS tenant_id FROM ledger WHERE leasenum IS NOT NULL AND payer IS NOT NULL
"""


def _names_used(sql: str) -> set[str]:
    words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "''", sql)))
    return {n for n in [*SHAPES, *STEPS] if n in words}


def _sql(body: str) -> str:
    """``body`` below the shapes and steps it names."""
    order: list[str] = []

    def need(sql: str, path: tuple[str, ...]) -> None:
        for n in sorted(_names_used(sql) - set(path)):
            source = shape_sql(n) if n in SHAPES else STEPS[n]
            if n in order:
                continue
            if n in STEPS:
                need(source, (*path, n))
            if n not in order:
                order.append(n)

    need(body, ())
    ctes = [f"{n} AS ({shape_sql(n) if n in SHAPES else STEPS[n]})" for n in order]
    body = body.strip()
    if body.startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


_INCOME_COLUMNS = ", ".join(INCOME.names)
_MESSAGE_HTML = "CASE WHEN lower(mime_type) LIKE 'text/html%' THEN {} ELSE {} END"


def _visible_text(c: str) -> str:
    out = c
    for pattern in markup.UNSEEN:
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    out = f"regexp_replace({out}, '{markup.BLOCK_TAG}', ' ', 'g')"
    out = f"regexp_replace({out}, '{markup.OTHER_TAG}', '', 'g')"
    for name, char in markup.NAMED_REFERENCES.items():
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    out = f"replace({out}, '&amp;', '&')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\f\\r\\x{{A0}}]+', ' ', 'g'))"


def _length_checks() -> str:
    parts = [
        f"SELECT 'length' AS check_id, 'units' AS \"table\", CAST(id AS VARCHAR) AS key, '{c} longer than {n}' AS reason "
        f"FROM units WHERE length({c}) > {n}"
        for c, n in UNITS.lengths.items()
    ]
    return " UNION ALL ".join(parts)


def _ledger_checks() -> str:
    parents = {"tenant": "known_tenant", "lease": "lease", "property": "property", "units": "units"}
    parts = ["SELECT 'primary_key' AS check_id, transaction_id AS key, 'duplicate key' AS reason FROM damaged "
             "GROUP BY transaction_id HAVING count(*) > 1"]
    for c, (parent, key) in INCOME.references.items():
        parts.append(f"SELECT DISTINCT 'foreign_key', CAST({c} AS VARCHAR), '{c} has no parent' FROM damaged d WHERE {c} IS NOT NULL "
                     f"AND NOT EXISTS (SELECT 1 FROM {parents[parent]} p WHERE p.{key} = d.{c})")
    for c, n in INCOME.lengths.items():
        parts.append(f"SELECT DISTINCT 'length', transaction_id, '{c} longer than {n}' FROM damaged WHERE length({c}) > {n}")
    parts.append("SELECT DISTINCT 'unreadable', transaction_id, 'original_amount unreadable' FROM damaged "
                 "WHERE original_amount IS NOT NULL AND TRY_CAST(original_amount AS DECIMAL(10,2)) IS NULL")
    return ("WITH damaged AS (SELECT * REPLACE (CASE WHEN line_no % 10 = 3 THEN status || ' in full' ELSE status END AS status, "
            "CAST(original_amount * 100000 AS DECIMAL(24,2)) AS original_amount) FROM ledger) "
            "SELECT check_id, 'income' AS \"table\", key, reason FROM (" + " UNION ALL ".join(parts) + ")")


_PROVIDER_REST = ", ".join(c for c in PROVIDER.names if c not in ("provider_id", "provider_name"))

def _whole_bodies() -> str:
    return (
        "(SELECT message_number, bool_or(multipart) AS multipart, coalesce(string_agg(text, '' ORDER BY part_no), '') AS body FROM "
        "(SELECT message_number, part_no, multipart, CASE WHEN lower(mime_type) LIKE 'text/plain%' THEN content "
        f"WHEN lower(mime_type) LIKE 'text/html%' THEN {_visible_text('content')} ELSE '' END AS text FROM parts) GROUP BY 1)"
    )


BODIES: dict[str, str] = {
    "vacancy_loss": f"WITH {_vacancy_steps('kept', False, False)} SELECT * FROM vacancies",
    "vacancy_loss_acquired": f"WITH {_vacancy_steps('kept', True, False)} SELECT * FROM vacancies",
    "vacancy_loss_continued": f"WITH {_vacancy_steps('kept_vacancies', False, True)} SELECT * FROM vacancies",
    "vacancy_loss_recompute": "WITH base AS (SELECT * FROM kept_vacancies WHERE NOT starts_with(transaction_id, "
    "CAST(year AS VARCHAR) || '-Vacant-')), "
    + _vacancy_steps("base", True, False)
    + f" SELECT {_INCOME_COLUMNS} FROM base UNION ALL SELECT {_INCOME_COLUMNS} FROM vacancies",
    "vacancy_ids_dense": f"WITH {_vacancy_steps('kept_vacancies', False, True)} "
    "SELECT year, count(*) AS n, min(no) AS first_no, max(no) AS last_no FROM (SELECT year, "
    "CAST(split_part(transaction_id, '-', 3) AS BIGINT) AS no FROM vacancies) GROUP BY year",
    "lowest_rent": "SELECT year, property, unit, min(original_amount) AS base_rent FROM kept "
    "WHERE transaction_category = 'Rent' AND property IS NOT NULL AND unit IS NOT NULL GROUP BY ALL",
    "next_numbers": "SELECT CAST(split_part(transaction_id, '-', 1) AS INTEGER) AS year, "
    "max(CAST(split_part(transaction_id, '-', 3) AS BIGINT)) + 1 AS next_no FROM ledger_with_vacancies "
    "WHERE transaction_id LIKE '%-Vacant-%' GROUP BY 1",
    "income_normalized": "SELECT line_no, transaction_id, status, type, transaction_category, method_of_payment, "
    "transaction_details, exclude_zaky, sd_applied, payer, payer_email, property_name, unit_name FROM normalized",
    "income_parsed": "SELECT line_no, created AS date_created, due AS due_date, paid AS date_paid, original_amount, "
    "payment, balance, CAST(NULL AS DECIMAL(10,2)) AS vacancy, leasenum, rent_month FROM parsed",
    "income_rejects": "SELECT line_no, transaction_id, CASE WHEN coalesce(transaction_id, '') = '' "
    "THEN 'missing transaction id' ELSE 'lease number is not a whole number' END AS reason "
    "FROM parsed WHERE coalesce(transaction_id, '') = '' OR bad_lease",
    "resolve_property_unit": "SELECT n.line_no, coalesce(p.id, 0) AS property, u.id AS unit FROM normalized n "
    "LEFT JOIN property p ON lower(p.name) = lower(n.property_name) "
    "LEFT JOIN units u ON u.property = p.id AND lower(u.name) = lower(n.unit_name)",
    "income_ledger": "SELECT * FROM built_ledger",
    "tenants_resolved": "SELECT tenant_id, name, email, phone FROM known_tenant UNION ALL "
    "SELECT tenant_id, name, email, '' AS phone FROM new_tenants",
    "leases_resolved": "SELECT lease_number, property, unit, start_date, end_date, year FROM lease UNION ALL "
    "SELECT leasenum, arg_min_null(property, line_no), arg_min_null(unit, line_no), NULL, NULL, "
    "arg_min(year, line_no) FROM keyed "
    "WHERE tenant_id IS NOT NULL AND leasenum IS NOT NULL AND leasenum NOT IN (SELECT lease_number FROM lease) "
    "GROUP BY leasenum",
    "lease_tenant_links": "SELECT DISTINCT leasenum AS lease_id, tenant_id FROM keyed "
    "WHERE tenant_id IS NOT NULL AND leasenum IS NOT NULL",
    "leases_with_tenants": "SELECT lease_number, property, unit, year, CAST(0 AS INTEGER) AS segment, "
    "coalesce((SELECT string_agg(CAST(tenant_id AS VARCHAR), ',' ORDER BY tenant_id) FROM links "
    "WHERE lease_id = lease_number), '') AS tenants FROM lease",
    "lease_member_pages": "SELECT lease_number, CAST(place // 2 AS INTEGER) AS segment, "
    "string_agg(CAST(tenant_id AS VARCHAR), ',' ORDER BY tenant_id) AS tenants FROM (SELECT lease_id AS lease_number, tenant_id, "
    "row_number() OVER (PARTITION BY lease_id ORDER BY tenant_id) - 1 AS place FROM links) GROUP BY 1, 2",
    "supplier_part_pages": "SELECT l_suppkey, CAST(place // 7 AS INTEGER) AS segment, "
    "string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM (SELECT l_suppkey, l_partkey, "
    "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS place "
    "FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY 1, 2",
    "lease_summaries": "SELECT lease_number, unit, (SELECT count(*) FROM links WHERE lease_id = lease_number) AS n "
    "FROM lease",
    "tenant_maps": "SELECT tenant_id, name, email, CAST(4 AS BIGINT) AS n FROM tenant",
    "tenant_latest_by_email": "SELECT * FROM tenant WHERE email <> '' "
    "QUALIFY row_number() OVER (PARTITION BY email ORDER BY tenant_id DESC) = 1",
    "distinct_property_units": "SELECT DISTINCT property, unit FROM ledger WHERE unit IS NOT NULL",
    "income_upsert_keep": f"SELECT {_INCOME_COLUMNS} FROM stored_ledger UNION ALL SELECT {_INCOME_COLUMNS} "
    "FROM first_ledger f WHERE NOT EXISTS (SELECT 1 FROM stored_ledger s WHERE s.transaction_id = f.transaction_id)",
    "income_upsert_overwrite": f"SELECT {_INCOME_COLUMNS} FROM stored_ledger s WHERE NOT EXISTS (SELECT 1 FROM "
    "last_ledger f WHERE s.transaction_id = f.transaction_id AND s.year = f.year) "
    f"UNION ALL SELECT {_INCOME_COLUMNS} FROM last_ledger f WHERE NOT EXISTS (SELECT 1 FROM stored_ledger s "
    "WHERE s.transaction_id = f.transaction_id AND s.year <> f.year)",
    "stored_key_lookup": "SELECT transaction_id, due_date, original_amount, year FROM stored_ledger WHERE transaction_id IN "
    "(SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')",
    "income_upsert_conflicts": "SELECT transaction_id, f.year AS scope, s.year AS existing_scope FROM last_ledger f "
    "JOIN stored_ledger s USING (transaction_id) WHERE s.year <> f.year",
    "income_upsert_actions": "SELECT CASE WHEN s.year IS NULL THEN 'insert' WHEN s.year <> f.year THEN 'conflict' "
    "ELSE 'skip' END AS action, count(*) AS n FROM first_ledger f LEFT JOIN stored_ledger s USING (transaction_id) "
    "GROUP BY 1",
    "first_row_per_key": "SELECT transaction_id, line_no, original_amount, due_date FROM first_ledger",
    "dim_upsert_full": "SELECT * FROM known_provider WHERE provider_id NOT IN (SELECT provider_id FROM shipped_names) "
    "UNION ALL SELECT provider_id, provider_name, NULL, NULL, NULL, NULL FROM shipped_names",
    "dim_upsert_partial": "SELECT coalesce(k.provider_id, s.provider_id) AS provider_id, "
    "CASE WHEN s.provider_id IS NOT NULL THEN s.provider_name ELSE k.provider_name END AS provider_name, "
    f"{_PROVIDER_REST} FROM known_provider k FULL JOIN shipped_names s ON k.provider_id = s.provider_id",
    "update_by_key": f"SELECT {_INCOME_COLUMNS} FROM stored_ledger s WHERE NOT EXISTS (SELECT 1 FROM last_ledger f "
    "WHERE f.transaction_id = s.transaction_id) "
    f"UNION ALL SELECT {_INCOME_COLUMNS} FROM last_ledger f WHERE EXISTS (SELECT 1 FROM stored_ledger s "
    "WHERE f.transaction_id = s.transaction_id)",
    "delete_by_predicate": "SELECT * FROM ledger_with_vacancies WHERE NOT (year IN (1995, 1996, 1997) AND "
    "starts_with(transaction_id, CAST(year AS VARCHAR) || '-Vacant-'))",
    "append_conformed": "SELECT transaction, date, year, amount, details, payment_mode, CAST(NULL AS VARCHAR) AS "
    "check_num, payment_account, property, unit, category, provider, type, CAST(NULL AS VARCHAR) AS exclude, "
    "exclude_zaky FROM expense UNION ALL SELECT transaction, NULL, year, amount, NULL, NULL, NULL, NULL, NULL, NULL, "
    "NULL, NULL, NULL, NULL, NULL FROM expense",
    "key_lookup": "SELECT line_no, transaction_id, unit FROM ledger WHERE unit IN "
    "(SELECT c_custkey + 1 FROM customer WHERE c_mktsegment = 'BUILDING')",
    "surrogate_keys": "SELECT name, kind, (SELECT max(id) FROM units) + row_number() OVER (ORDER BY name, kind) AS id "
    "FROM (SELECT DISTINCT p_name AS name, p_type AS kind FROM part)",
    "placeholder_member": "SELECT * FROM property UNION ALL SELECT 0, 'Unknown Property', '', 0, NULL",
    "bank_staging_landed": f"SELECT row_number() OVER (ORDER BY source_file, {_LINE}) AS id, m.id AS file_id, details, "
    "posting_date, description, amount, type, check_num, s.year, CAST(NULL AS VARCHAR) AS is_processed "
    "FROM staged s LEFT JOIN manifest m ON m.file_path = s.source_file",
    "bank_name_extract": "SELECT trim(regexp_extract(description, '(?is)ORIG CO NAME:(.*?)(?:ORIG ID:|$)', 1)) AS bank, "
    "count(*) AS n FROM staged GROUP BY 1",
    "trn_extract": f"SELECT {_LINE}, trn FROM judged",
    "account_from_path": "SELECT id, split_part(substr(file_path, 5), '_', 1) || '-' || "
    "split_part(substr(file_path, 5), '_', 2) AS account FROM manifest",
    "counterparty_rules": "SELECT lender, property_name, CASE WHEN lender IS NOT NULL THEN CASE WHEN amount IS NULL "
    "THEN 'N' ELSE 'Y' END END AS outcome, count(*) AS n FROM judged GROUP BY 1, 2, 3",
    "land_same_file": "SELECT coalesce(m.id, -1) AS file_key, count(*) AS rows, 'same' AS action, CAST(0 AS BIGINT) AS landed "
    "FROM staged s LEFT JOIN manifest m ON m.file_path = s.source_file GROUP BY 1",
    "land_changed_file": f"""
WITH e AS (SELECT *, line_source % 100 % 4 AS kind FROM judged),
was AS (SELECT * REPLACE (CASE WHEN kind = 1 AND line_item = 1 THEN CAST(1 AS DECIMAL(10,2)) ELSE amount END AS amount),
    row_number() OVER (ORDER BY source_file, {_LINE}) AS id FROM e WHERE kind <> 3 AND NOT (kind = 0 AND line_item > 2)),
old AS (SELECT *, CASE WHEN lender IS NOT NULL THEN CASE WHEN amount IS NULL THEN 'N' ELSE 'Y' END END AS mark FROM was),
c AS (SELECT file_id, bool_or(kind = 3 OR (kind = 0 AND line_item > 2)
    OR (kind = 1 AND line_item = 1 AND amount IS DISTINCT FROM CAST(1 AS DECIMAL(10,2)))) AS changed FROM e GROUP BY file_id),
k AS (SELECT file_id, {_CONTENT}, max(mark) AS mark FROM old WHERE mark IS NOT NULL GROUP BY ALL)
SELECT id, file_id, {_CONTENT}, mark AS is_processed FROM old JOIN c USING (file_id) WHERE NOT changed
UNION ALL SELECT (SELECT max(id) FROM was) + row_number() OVER (ORDER BY source_file, {_LINE}), e.file_id,
  {", ".join("e." + x for x in _CONTENT.split(", "))}, k.mark
FROM e JOIN c USING (file_id) LEFT JOIN k ON k.file_id = e.file_id AND
  {" AND ".join(f"k.{x} IS NOT DISTINCT FROM e.{x}" for x in _CONTENT.split(", "))} WHERE changed""",
    "loan_payments": "SELECT * FROM payments",
    "loan_payments_null_year": STEPS["payments"].replace("j.year", "year(posting_date)").replace(
        "principal, year(posting_date)", "principal, CAST(year(posting_date) AS INTEGER) AS year") + " AND posting_date IS NOT NULL",
    "loan_status_null_year": f"SELECT {_LINE}, CASE WHEN lender IS NOT NULL THEN CASE WHEN amount IS NULL OR posting_date IS NULL "
    "THEN 'N' ELSE 'Y' END END AS is_processed FROM judged",
    "utility_expenses": "SELECT * FROM utility_rows",
    "utility_outcomes": "SELECT is_processed AS outcome, reject_reason, count(*) AS n FROM marked WHERE utility "
    "GROUP BY 1, 2",
    "staging_status": f"SELECT {_LINE}, file_id, is_processed FROM marked",
    "status_update_by_id": f"SELECT {_LINE}, CASE WHEN lender IS NOT NULL THEN CASE WHEN amount IS NULL THEN 'N' "
    "ELSE 'Y' END END AS is_processed FROM judged",
    "file_counts": "SELECT file_id, count(*) AS total_rows, count(*) FILTER (WHERE is_processed = 'Y') AS success_rows, "
    "count(*) FILTER (WHERE is_processed = 'N') AS failed_rows FROM marked GROUP BY 1",
    "manifest_counts": "SELECT e.id, e.file_path, e.year, e.file_type, c.total_rows, c.success_rows, c.failed_rows "
    "FROM earlier_manifest e LEFT JOIN (SELECT file_id, count(*) AS total_rows, "
    "count(*) FILTER (WHERE is_processed = 'Y') AS success_rows, "
    "count(*) FILTER (WHERE is_processed = 'N') AS failed_rows FROM marked GROUP BY 1) c ON c.file_id = e.id",
    "file_manifest": "WITH seen AS (SELECT source_file AS file_path, max(CAST(year(line_day) AS INTEGER)) AS year "
    "FROM raw_bank GROUP BY 1), fresh AS (SELECT * FROM seen WHERE file_path NOT IN "
    "(SELECT file_path FROM earlier_manifest)) "
    "SELECT e.id, e.file_path, coalesce(s.year, e.year) AS year, e.file_type, e.total_rows, e.success_rows, "
    "e.failed_rows FROM earlier_manifest e LEFT JOIN seen s USING (file_path) UNION ALL "
    "SELECT (SELECT max(id) FROM earlier_manifest) + row_number() OVER (ORDER BY file_path), file_path, year, "
    "'bank_transactions_raw', NULL, NULL, NULL FROM fresh",
    "unprocessed_files": "SELECT DISTINCT source_file AS file_path, CAST(year(line_day) AS INTEGER) AS year "
    "FROM raw_bank r WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.file_path = r.source_file "
    "AND m.year = year(r.line_day))",
    "income_view": "SELECT i.* EXCLUDE (line_no), i.year AS income_year, t.name AS payer_name, p.name AS property_name, "
    "u.name AS unit_name, l.lease_number FROM ledger i LEFT JOIN tenant t ON i.payer = t.tenant_id "
    "LEFT JOIN property p ON i.property = p.id LEFT JOIN units u ON i.unit = u.id "
    "LEFT JOIN lease l ON i.leasenum = l.lease_number",
    "vacancy_view": "SELECT transaction_id, status, date_created, i.year, rent_month, vacancy, p.name AS property, "
    "u.name AS unit FROM ledger_with_vacancies i LEFT JOIN property p ON i.property = p.id "
    "LEFT JOIN units u ON i.unit = u.id WHERE status = 'Vacancy'",
    "expense_view": "SELECT e.year AS expense_year, p.name AS property_name, u.name AS unit_name, c.category_name, "
    "r.provider_name FROM expense e LEFT JOIN property p ON e.property = p.id LEFT JOIN units u ON e.unit = u.id "
    "LEFT JOIN expense_category c ON e.category = c.category_id LEFT JOIN provider r ON e.provider = r.provider_id",
    "expense_view_full": "SELECT e.transaction, e.amount, e.year AS expense_year, p.name AS property_name, "
    "u.name AS unit_name, c.category_name, r.provider_name FROM expense e LEFT JOIN property p ON e.property = p.id "
    "LEFT JOIN units u ON e.unit = u.id LEFT JOIN expense_category c ON e.category = c.category_id "
    "LEFT JOIN provider r ON e.provider = r.provider_id",
    "message_search": "SELECT message_number, subject, sender AS \"from\", body FROM messages "
    "WHERE lower(sender) LIKE '%user1%' AND received_date >= DATE '2024-01-05' AND received_date < DATE '2024-01-21' "
    "AND lower(subject) LIKE '%purchase%' AND contains(lower(body), '\"k\": 1') AND NOT is_read",
    "message_search_all": "SELECT message_number FROM messages",
    "message_range": "SELECT message_number, subject FROM messages WHERE received_date >= DATE '2024-01-03' "
    "AND received_date < DATE '2024-01-10'",
    "message_unread": "SELECT message_number, kind FROM messages WHERE received_date >= DATE '2024-01-03' "
    "AND received_date < DATE '2024-01-10' AND NOT is_read",
    "message_recent_days": "SELECT message_number, kind FROM messages WHERE received_date >= DATE '2024-01-18' "
    "AND received_date < DATE '2024-01-26'",
    "message_top_n": "SELECT message_number, subject FROM messages ORDER BY message_number DESC LIMIT 50",
    "bill_notices": "SELECT message_number, subject FROM messages WHERE contains(lower(subject), 'error notice 1') "
    "OR contains(lower(subject), 'signup notice') OR contains(lower(subject), 'click notice 77')",
    "html_to_text": f"SELECT page_id, {_visible_text('html')} AS text FROM pages",
    "message_body": "SELECT message_number, CAST(0 AS INTEGER) AS segment, string_agg(text, '' ORDER BY part_no) AS body "
    "FROM (SELECT message_number, part_no, CASE WHEN lower(mime_type) LIKE 'text/plain%' THEN content "
    f"WHEN lower(mime_type) LIKE 'text/html%' THEN {_visible_text('content')} ELSE '' END AS text FROM parts) GROUP BY 1",
    "message_body_pages": "SELECT message_number, CAST(part_no // 2 AS INTEGER) AS segment, "
    "string_agg(text, '' ORDER BY part_no) AS body "
    "FROM (SELECT message_number, part_no, CASE WHEN lower(mime_type) LIKE 'text/plain%' THEN content "
    f"WHEN lower(mime_type) LIKE 'text/html%' THEN {_visible_text('content')} ELSE '' END AS text FROM parts) GROUP BY 1, 2",
    "message_body_bytes": f"SELECT message_number, CAST(s AS INTEGER) AS segment, substr(body, s * 150 + 1, 150) AS body FROM "
    f"(SELECT *, unnest(range(greatest(1, (length(body) + 149) // 150))) AS s FROM {_whole_bodies()})",
    "bill_notice_details": "WITH n AS (SELECT * FROM messages WHERE contains(lower(subject), 'click notice') "
    "OR contains(lower(subject), 'view notice') OR contains(lower(subject), 'error notice 1')), "
    f"b AS (SELECT message_number, s, substr(body, s * 200 + 1, 200) AS body, multipart FROM "
    f"(SELECT *, unnest(range(greatest(1, (length(body) + 199) // 200))) AS s FROM {_whole_bodies()})), "
    "f AS (SELECT message_number, part_no // 2 AS s, string_agg(coalesce(file_name, '-'), ',' ORDER BY part_no) AS files FROM parts "
    "WHERE multipart AND lower(trim(disposition)) = 'attachment' GROUP BY 1, 2), "
    "r AS (SELECT message_number, place // 2 AS s, string_agg(address, ',' ORDER BY place) AS addresses FROM recipients "
    "WHERE lower(trim(kind)) = 'to' GROUP BY 1, 2), "
    "k AS (SELECT message_number, 0 AS s FROM n UNION SELECT message_number, s FROM b UNION SELECT message_number, s FROM f "
    "UNION SELECT message_number, s FROM r) "
    "SELECT k.message_number, CAST(k.s AS INTEGER) AS segment, CASE WHEN k.s = 0 THEN subject END AS subject, "
    "CASE WHEN k.s = 0 THEN sender END AS \"from\", CASE WHEN k.s = 0 THEN received_date END AS received_date, "
    "coalesce(b.body, '') AS body, CASE WHEN multipart OR files IS NOT NULL THEN coalesce(files, '') END AS attachments, "
    "addresses AS recipients FROM k JOIN n USING (message_number) LEFT JOIN b ON b.message_number = k.message_number AND b.s = k.s "
    "LEFT JOIN f ON f.message_number = k.message_number AND f.s = k.s LEFT JOIN r ON r.message_number = k.message_number AND r.s = k.s",
    "bill_notices_no_phrases": "SELECT message_number, subject FROM messages WHERE false",
    "message_attachments": "SELECT message_number, CAST(0 AS INTEGER) AS segment, CASE WHEN any_value(multipart) THEN "
    "coalesce(string_agg(file_name, ',' ORDER BY part_no) FILTER (WHERE lower(trim(disposition)) = 'attachment'), '') "
    "END AS attachments FROM parts GROUP BY 1",
    "message_addresses": "SELECT message_number, CASE WHEN message_number % 9 <> 0 THEN sender END AS first_sender "
    "FROM messages",
    "dq_keys": "SELECT 'primary_key' AS check_id, 'income' AS \"table\", coalesce(k, 'NULL') AS key, "
    "CASE WHEN k IS NULL THEN 'missing key' ELSE 'duplicate key' END AS reason FROM "
    f"(SELECT {_opt('transaction_id')} AS k FROM raw_invoices) GROUP BY k HAVING k IS NULL OR count(*) > 1",
    "dq_unique": "SELECT 'unique' AS check_id, 'expense_category' AS \"table\", category_name AS key, "
    "'duplicate value' AS reason FROM expense_category GROUP BY category_name HAVING count(*) > 1",
    "dq_money_fits": "SELECT 'unreadable' AS check_id, 'orders' AS \"table\", CAST(o_orderkey AS VARCHAR) AS key, "
    "'total unreadable' AS reason FROM orders "
    "WHERE TRY_CAST(CAST(o_totalprice * 1000 AS DECIMAL(18,2)) AS DECIMAL(10,2)) IS NULL",
    "dq_foreign_keys": "SELECT DISTINCT 'foreign_key' AS check_id, 'income' AS \"table\", CAST(payer AS VARCHAR) AS key, "
    "'payer has no parent' AS reason FROM ledger WHERE payer NOT IN (SELECT tenant_id FROM known_tenant) UNION ALL "
    "SELECT DISTINCT 'foreign_key', 'income', CAST(leasenum AS VARCHAR), 'leasenum has no parent' FROM ledger "
    "WHERE leasenum NOT IN (SELECT lease_number FROM lease)",
    "dq_lengths": _length_checks(),
    "dq_ledger": _ledger_checks(),
    "dq_unreadable": " UNION ALL ".join(
        f"SELECT 'unreadable' AS check_id, 'income' AS \"table\", CAST(line_no AS VARCHAR) AS key, "
        f"'{c} unreadable' AS reason FROM raw_invoices WHERE trim({c}) NOT IN ('', '-') AND {value} IS NULL"
        for c, value in (
            ("due_date", _date("trim(due_date)")),
            ("original_amount", _money("original_amount")),
            ("leasenum", "TRY_CAST(leasenum AS BIGINT)"),
        )
    ),
    "dq_table": "SELECT 'foreign_key' AS check_id, 'units' AS \"table\", CAST(property AS VARCHAR) AS key, "
    "'property has no parent' AS reason FROM (SELECT DISTINCT property FROM units) "
    "WHERE property NOT IN (SELECT id FROM property WHERE acquired_date IS NOT NULL) UNION ALL " + _length_checks(),
    "csv_scan_spanning": "SELECT source_file, trim(CASE line_item % 3 WHEN 0 THEN description WHEN 1 THEN 'a \"b\",' || chr(10) || "
    "description ELSE description || chr(10) || chr(10) || '\"' || chr(10) || 'end, of' END) AS description, trim(amount) AS amount, "
    "nullif(check_or_slip, '') AS check_num FROM raw_bank",
    "csv_scan": "SELECT details, posting_date, description, amount, type, check_num FROM staged",
    "csv_file_numbers": "SELECT count(*) AS n, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id, "
    "CAST(count(*) * (count(*) + 1) / 2 AS BIGINT) AS sum_id FROM supplier",
    "csv_column_mapping": "SELECT nullif(trim(transaction_id), '') AS transaction_id, nullif(trim(status), '') AS status, "
    "nullif(trim(due_date), '') AS due_date, trim(original_amount) AS original_amount, trim(leasenum) AS leasenum, "
    "CAST(NULL AS VARCHAR) AS unit FROM raw_invoices",
    "dims_refresh": "WITH known AS (SELECT * FROM property WHERE full_address < 'Region 3') "
    "SELECT CAST(n.n_nationkey + 1 AS BIGINT) AS id, lower(n_name) AS name, 'addr' AS full_address, "
    "CAST(n_regionkey AS INTEGER) AS number_of_units, k.acquired_date FROM nation n LEFT JOIN known k "
    "ON k.id = n.n_nationkey + 1 UNION ALL SELECT 0, 'Unknown Property', '', 0, NULL",
    "run_year": f"WITH {_vacancy_steps('built_ledger', True, False)}, "
    "final_income AS (SELECT year, original_amount FROM built_ledger UNION ALL "
    "SELECT year, original_amount FROM vacancies) "
    "SELECT 'income' AS ledger, year, count(*) AS n, CAST(sum(original_amount) AS DECIMAL(20,2)) AS total "
    "FROM final_income GROUP BY year UNION ALL "
    "SELECT 'bank_payment', year, count(*), CAST(sum(total_amount) AS DECIMAL(20,2)) FROM payments GROUP BY year "
    "UNION ALL SELECT 'expense', year, count(*), CAST(sum(amount) AS DECIMAL(20,2)) FROM utility_rows GROUP BY year",
    "run_year_rows": f"WITH {_vacancy_steps('built_ledger', True, False)} "
    "SELECT 'income' AS ledger, transaction_id AS key, due_date AS day, property, CAST(original_amount AS DECIMAL(20,2)) AS amount, year "
    "FROM built_ledger UNION ALL SELECT 'income', transaction_id, due_date, property, CAST(original_amount AS DECIMAL(20,2)), year FROM vacancies "
    "UNION ALL SELECT 'bank_payment', transaction_id, date, property, CAST(total_amount AS DECIMAL(20,2)), year FROM payments "
    "UNION ALL SELECT 'expense', transaction, date, property, CAST(amount AS DECIMAL(20,2)), year FROM utility_rows",
}


# the stored table holds what the upsert makes
BODIES["upsert_touched"] = BODIES["income_upsert_overwrite"]


def oracle_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in BODIES.items()}
