import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from rentroll.operators.lookup import LoanRule
from rentroll.plans import bank, ledger, messages, vacancy, views, year_run
from rentroll.schemas import (
    BANK_PAYMENT, EXPENSE, EXPENSE_CATEGORY, FILE_PROCESSING, INCOME, LEASE, LEASE_TENANT, PROPERTY, PROVIDER,
    STAGING, TENANT, UNITS, conform,
)
from rentroll.sources import manifest

D = dt.date


def rent(rows, data):
    """(id, status, due, category, amount, property, unit, year)"""
    ddl = ("transaction_id string, status string, due_date date, transaction_category string, original_amount string, "
           "property bigint, unit bigint, year int")
    return conform(rows(data, ddl), INCOME.schema)


def test_one_rent_month_gives_eleven_vacancies(rows):
    income = rent(rows, [("2025-TXN-1", "Paid", D(2025, 1, 1), "Rent", "1000", 1, 101, 2025)])
    out = vacancy.generate_vacancy_loss(income, rows([(1, "P1", "A1", 1, None)], PROPERTY.ddl))
    got = sorted(out.collect(), key=lambda r: r["due_date"])
    assert [r["transaction_id"] for r in got] == [f"2025-Vacant-{i}" for i in range(1, 12)]
    assert [r["due_date"].month for r in got] == list(range(2, 13))
    r = got[0]
    assert (r["status"], r["type"], r["transaction_category"], r["rent_month"]) == ("Vacancy", "Income", "Rent", "February")
    assert r["vacancy"] == r["original_amount"] == Decimal("1000.00") and r["date_created"] == r["due_date"]
    assert all(r[c] is None for c in ("date_paid", "payment", "balance", "payer", "leasenum", "method_of_payment",
                                      "transaction_details", "exclude_zaky", "sd_applied"))


def test_vacancy_is_idempotent_and_recomputes(rows):
    income = rent(rows, [
        ("a", "Paid", D(2025, 1, 1), "Rent", "1000", 1, 101, 2025), ("b", "Paid", D(2025, 2, 1), "Rent", "900", 1, 101, 2025),
        ("c", "Paid", D(2025, 3, 1), "rent", "1", 1, 102, 2025), ("2025-Vacant-40", "Vacancy", D(2025, 3, 1), "Rent", "950", 1, 101, 2025),
        ("d", "Paid", D(2025, 3, 1), "Rent", "5", None, 101, 2025),
    ])
    once = vacancy.ledger_with_vacancy_loss(income)
    new = once.join(income.select("transaction_id"), "transaction_id", "left_anti")
    assert sorted(r["transaction_id"] for r in new.collect()) == sorted(f"2025-Vacant-{i}" for i in range(41, 50))
    assert {r["original_amount"] for r in new.collect()} == {Decimal("900.00")}
    assert vacancy.ledger_with_vacancy_loss(once).count() == once.count()
    again = vacancy.ledger_with_vacancy_loss(once, recompute=True)
    ids = [r["transaction_id"] for r in again.collect()]
    assert len(ids) == 4 + 10 and "2025-Vacant-1" in ids and "2025-Vacant-40" not in ids


def test_vacancy_after_acquisition(rows):
    income = rent(rows, [(str(p), "Paid", D(2025, 1, 1), "Rent", "10", p, p, 2025) for p in (1, 2, 3, 4)])
    dates = {1: D(2025, 10, 3), 2: D(2024, 5, 1), 3: D(2026, 1, 1), 4: D(2025, 11, 30)}
    properties = rows([(p, "", "", 1, d) for p, d in dates.items()], PROPERTY.ddl)
    out = vacancy.vacant_months(income, properties).groupBy("property").count().collect()
    assert {r["property"]: r["count"] for r in out} == {1: 1, 2: 11}
    out = vacancy.vacant_months(income, properties, acquisition_offset=1).groupBy("property").count().collect()
    assert {r["property"]: r["count"] for r in out} == {1: 2, 2: 11, 4: 1}


RAW = ("transaction_id string, status string, date_created string, due_date string, date_paid string, type string, "
       "transaction_category string, original_amount string, payment string, balance string, method_of_payment string, "
       "payer string, payer_email string, leasenum string, property string, unit string, transaction_details string, line int")


def invoice(line, **kw):
    base = dict(transaction_id=str(line), status="Paid", date_created="2025-01-01", due_date="1/1/2025", date_paid="-",
                type="Income / One Time", transaction_category="Rent", original_amount="$1,000.00", payment="", balance="-",
                method_of_payment="ACH, ACH", payer="Ann", payer_email="ann@e", leasenum="7", property="Main", unit="A",
                transaction_details="", line=line)
    return tuple({**base, **kw}.values())


def build(rows, raw, tenants=(), income=(), overwrite=False):
    return ledger.build_income_ledger(
        rows(raw, RAW), rows([(1, "main", "", 1, None)], PROPERTY.ddl),
        rows([(11, "a", 1, 1, 1, "N", "N", "N", None, None)], UNITS.ddl), rows(list(income), INCOME.ddl),
        rows(list(tenants), TENANT.ddl), rows([], LEASE.ddl), rows([], LEASE_TENANT.ddl), 2025, ["line"], overwrite,
    )


def test_income_ledger(rows):
    raw = [
        invoice(1), invoice(2, payer="Bob", payer_email=""), invoice(3, payer="Bob", payer_email=None, leasenum="8"),
        invoice(4, status="void"), invoice(5, transaction_category="credits "), invoice(6, transaction_id="-"),
        invoice(7, leasenum="L7"), invoice(8, payer="-", leasenum="9", property="Nowhere"),
        invoice(9, transaction_id="1", payer="Cy", payer_email="cy@e", method_of_payment="Cash", type=" "),
    ]
    out = build(rows, raw, tenants=[(40, "Ann old", "ann@e", ""), (41, "Ann", "ann@e", "")])
    got = {r["transaction_id"]: r for r in out.ledger.collect()}
    assert sorted(got) == ["1", "2", "3", "8"]
    assert got["1"]["payer"] == 41 and got["1"]["original_amount"] == Decimal("1000.00")
    assert (got["1"]["method_of_payment"], got["1"]["rent_month"], got["1"]["property"], got["1"]["unit"]) == ("ACH", "January", 1, 11)
    assert got["2"]["payer"] == got["3"]["payer"] == 42
    assert (got["8"]["payer"], got["8"]["property"], got["8"]["unit"], got["8"]["leasenum"]) == (None, 0, None, 9)
    assert sorted(r["line"] for r in out.rejects.collect()) == [6, 7]
    assert {(r["tenant_id"], r["name"]) for r in out.tenants.collect()} == {(40, "Ann old"), (41, "Ann"), (42, "Bob"), (43, "Cy")}
    assert {r["lease_number"] for r in out.leases.collect()} == {7, 8}
    assert {tuple(r) for r in out.lease_tenants.collect()} == {(7, 41), (7, 42), (8, 42), (7, 43)}
    listed = ledger.leases_with_tenants(out.leases, out.lease_tenants).collect()
    assert {r["lease_number"]: r["tenants"] for r in listed} == {7: [41, 42, 43], 8: [42]}
    again = build(rows, raw, income=[tuple(r) for r in out.ledger.collect()])
    assert {r["action"] for r in again.actions.collect()} == {"skip"} and again.ledger.count() == 4


def staged(spark, rows):
    data = [
        ("DEBIT", "12/18/2025", "ORIG CO NAME:Lender A       ORIG ID:1 Marker  One", "-543.41", "ACH_DEBIT", "0.00", None),
        ("DEBIT", "12/08/2025", "orig co name:lender a       ORIG ID:1 MARKER TWO", "-2253.81", "ACH_DEBIT", "0.00", None),
        ("DEBIT", "12/31/2025", "ORIG CO NAME:Lender B       ORIG ID:2", "-10.00", "ACH_DEBIT", "0.00", ""),
        ("CREDIT", "12/31/2025", "ORIG CO NAME:Lender B       ORIG ID:2", "10.00", "ACH_CREDIT", "0.00", None),
        ("DEBIT", "bad", "ORIG CO NAME:Lender B", "n/a", "ACH_DEBIT", "0.00", None),
    ]
    ddl = "`details` string, `posting date` string, description string, amount string, type string, balance string, `check or slip #` string"
    raw = rows([(*r, "/in/Bank_0001_x.csv", i) for i, r in enumerate(data)], ddl + ", source_file string, line int")
    files = raw.select(F.col("source_file").alias("file_path"), F.lit(2025).alias("year"))
    known = manifest.register_files(rows([], FILE_PROCESSING.ddl), files, manifest.BANK_FILES)
    return bank.land_bank_export(raw, known, 2025, order_by=["line"]), known


RULES = [LoanRule("ORIG CO NAME:LENDER A", "MARKER  ONE", "Prop 1"), LoanRule("ORIG CO NAME:LENDER A", "MARKER TWO", "prop 2"),
         LoanRule("ORIG CO NAME:LENDER B")]


def test_loan_payments(spark, rows):
    staging, known = staged(spark, rows)
    assert staging.count() == 5 and staging.select("file_id").distinct().first()[0] == 1
    properties = rows([(1, "Prop 1", "", 1, None), (2, "Prop 2", "", 1, None)], PROPERTY.ddl)
    out = bank.derive_loan_payments(staging, RULES, properties, rows([], BANK_PAYMENT.ddl))
    got = {r["transaction_id"]: (r["property"], r["bank"], r["total_amount"]) for r in out.payments.collect()}
    assert got == {
        "2025-BANKPAY-1": (1, "Lender A", Decimal("-543.41")), "2025-BANKPAY-2": (2, "lender a", Decimal("-2253.81")),
        "2025-BANKPAY-3": (0, "Lender B", Decimal("-10.00")),
    }
    assert [r["is_processed"] for r in out.staging.orderBy("id").collect()] == ["Y", "Y", "Y", None, "N"]
    counts = manifest.write_counts(known, manifest.file_counts(out.staging)).first()
    assert (counts["total_rows"], counts["success_rows"], counts["failed_rows"]) == (5, 3, 1)
    again = bank.derive_loan_payments(out.staging, RULES, properties, out.payments)
    assert again.new_payments.count() == 0 and again.payments.count() == 3


def test_utility_expenses(rows):
    data = [
        (1, "DEBIT", D(2025, 1, 2), "ORIG CO NAME:Utility X INTERNET TRN:99999", "75.00"),
        (2, "debit", D(2025, 1, 3), "ORIG CO NAME:UTILITY X INTERNET TRN:11111", "25.00"),
        (3, "DEBIT", D(2025, 1, 3), "ORIG CO NAME:Utility X no number", "25.00"),
        (4, "DEBIT", None, "ORIG CO NAME:Utility X TRN:4", "25.00"),
        (5, "DEBIT", D(2025, 1, 3), "ORIG CO NAME:Utility X TRN:5", None),
        (6, "CREDIT", D(2025, 1, 3), "ORIG CO NAME:Utility X TRN:6", "1"),
        (7, "DEBIT", D(2025, 1, 9), "ORIG CO NAME:Utility X TRN: 11111", "50.00"),
    ]
    staging = conform(
        rows([(i, 1, d, p, t, a, "ACH", 2025) for i, d, p, t, a in data],
             "id bigint, file_id bigint, details string, posting_date date, description string, amount string, type string, year int"),
        STAGING.schema,
    )
    known = rows([(1, "/in/Bank_0001_ALL.CSV", None, 2025, "t", 0, 0, 0)], FILE_PROCESSING.ddl)
    properties = rows([(1, "Property A", "", 1, None), (2, "Property B", "", 1, None)], PROPERTY.ddl)
    rule = bank.UtilityRule("ORIG CO NAME:UTILITY X", "Utility X", "Property A", "Property B")
    args = (rule, known, properties, rows([(8, "utility")], EXPENSE_CATEGORY.ddl),
            conform(rows([(9, "UTILITY X")], "provider_id bigint, provider_name string"), PROVIDER.schema))
    out = bank.derive_utility_expenses(staging, *args, rows([], EXPENSE.ddl))
    got = {r["transaction"]: r for r in out.expenses.collect()}
    assert sorted(got) == ["SE-2025-11111", "SE-2025-99999"]
    a, b = got["SE-2025-99999"], got["SE-2025-11111"]
    assert (a["property"], b["property"], b["date"], a["unit"]) == (1, 2, D(2025, 1, 9), None)
    assert (a["payment_account"], a["payment_mode"], a["exclude"], a["exclude_zaky"]) == ("Bank-0001", "ACH", "N", "N")
    assert (a["category"], a["provider"], a["type"]) == (8, 9, "Operation")
    assert [r["is_processed"] for r in out.staging.orderBy("id").collect()] == ["Y", "Y", "N", "N", "N", None, "Y"]
    again = bank.derive_utility_expenses(out.staging, *args, out.expenses)
    assert again.expenses.count() == 2


def test_views_keep_row_count(rows):
    income = rent(rows, [("1", "Vacancy", D(2025, 1, 1), "Rent", "1", 1, 11, 2025), ("2", "Paid", None, "Rent", "1", 5, None, 2025)])
    twice = rows([(1, "P"), (1, "P")], "id bigint, name string")
    view = views.income_view(income, rows([], TENANT.ddl), twice, rows([(11, "U")], "id bigint, name string"), rows([], LEASE.ddl))
    assert view.count() == 2 and view.columns[-5:] == ["income_year", "payer_name", "property_name", "unit_name", "lease_number"]
    row = views.vacancy_view(income, twice, rows([(11, "U")], "id bigint, name string")).first()
    assert (row["property"], row["unit"]) == ("P", "U")


def test_messages(rows):
    parts = rows([(1, i, "text/plain", str(i % 10), "attachment", f"f{i}", True) for i in range(25)]
                 + [(2, 0, "text/html", "<p>a</p>b", None, None, False), (3, 0, "text/plain", "x", "inline", "n", True)],
                 "message_number bigint, part_no int, mime_type string, content string, disposition string, file_name string, multipart boolean")
    whole = {r["message_number"]: r["body"] for r in messages.message_bodies(parts).collect()}
    assert whole == {1: "0123456789" * 2 + "01234", 2: "a b", 3: "x"}
    pieces = messages.message_bodies(parts, parts_per_row=10).filter("message_number = 1").orderBy("segment").collect()
    assert "".join(r["body"] for r in pieces) == whole[1] and len(pieces) == 3
    for size in (1, 7, 25, 100):
        pages = sorted(tuple(r) for r in messages.bounded_bodies(parts, size).collect())
        assert pages == sorted((m, s, t[s * size : (s + 1) * size]) for m, t in whole.items() for s in range(-(-len(t) // size)))
    files = {r["message_number"]: r["attachments"] for r in messages.attachments(parts).collect()}
    assert files[1] == [f"f{i}" for i in range(25)] and files[2] is None and files[3] == []
    mail = rows([(1, "Your Bill", "a@e", dt.datetime(2025, 1, 31, 23, 59), "due", False),
                 (2, "hello", "b@e", dt.datetime(2025, 2, 1), "bill", True), (3, None, None, None, None, None)],
                "message_number bigint, subject string, `from` string, received_date timestamp, body string, `read` boolean")
    ids = lambda df: sorted(r["message_number"] for r in df.collect())
    assert ids(messages.search(mail, messages.SearchCriteria())) == [1, 2, 3]
    assert ids(messages.search(mail, messages.SearchCriteria(subject="BILL", sender="", unread_only=True))) == [1]
    assert ids(messages.in_range(mail, D(2025, 1, 1), D(2025, 1, 31))) == [1]
    assert ids(messages.trailing_days(mail, D(2025, 2, 7))) == [1, 2]
    assert ids(messages.most_recent(mail, 2)) == [2, 3] and ids(messages.most_recent(mail, 0)) == []
    assert ids(messages.bill_notices(mail, ["invoice", "bill"])) == [1]


def test_year_run(spark, rows):
    landed, known = staged(spark, rows)
    tables = {
        "property": rows([(1, "main", "", 1, None)], PROPERTY.ddl),
        "units": rows([(11, "a", 1, 1, 1, "N", "N", "N", None, None)], UNITS.ddl),
        "income": rows([], INCOME.ddl), "tenant": rows([], TENANT.ddl), "lease": rows([], LEASE.ddl),
        "lease_tenant": rows([], LEASE_TENANT.ddl), "bank_payment": rows([], BANK_PAYMENT.ddl),
        "bank_transaction_staging": rows([], STAGING.ddl), "file_processing": known,
        "expense": rows([], EXPENSE.ddl), "expense_category": rows([], EXPENSE_CATEGORY.ddl), "provider": rows([], PROVIDER.ddl),
    }
    out = year_run.run_year(tables, 2025, rows([invoice(1)], RAW), landed, RULES, None, order_by=["line"])
    assert out["income"].count() == 12 and out["bank_payment"].count() == 3
    assert out["file_processing"].first()["failed_rows"] == 1
    assert sorted(r["id"] for r in out["property"].collect()) == [0, 1]

    # the same run once more, on what the first one left, changes nothing
    again = year_run.run_year({k: out[k] for k in tables}, 2025, rows([invoice(1)], RAW), landed, RULES, None, order_by=["line"])
    for name in ("income", "bank_payment", "bank_transaction_staging", "property", "lease", "tenant"):
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, out[name].collect())), name


def test_absent_headers_are_null(spark, rows):
    few = rows([("DEBIT", "12.50")], "details string, amount string")
    row = bank.staged_columns(few, 2025).first()
    assert (row["details"], float(row["amount"]), row["description"], row["check_num"], row["posting_date"]) == ("DEBIT", 12.5, None, None, None)
    parsed = ledger.parse_invoices(ledger.normalize_invoices(rows([("t1", "10")], "transaction_id string, payment string"))).first()
    assert (parsed["transaction_id"], float(parsed["payment"]), parsed["due_date"]) == ("t1", 10.0, None)


def test_landing_goes_on_after_stored_rows(spark, rows):
    first, known = staged(spark, rows)
    stored = spark.createDataFrame(first.collect(), first.schema)
    raw = rows([("DEBIT", "/new.csv", 1)], "details string, source_file string, line int")
    more = bank.land_bank_export(raw, known, 2025, order_by=["line"], staging=stored).collect()
    assert [r["id"] for r in more] == [max(r["id"] for r in stored.collect()) + 1]


def test_landing_again(spark, rows):
    """Equal files are skipped, changed ones replace their rows; content seen before keeps its mark."""
    from rentroll.plans import bank
    from rentroll.schemas import FILE_PROCESSING

    ddl = "source_file string, n int, details string, `posting date` string, description string, amount string, type string"

    def export(changes=(), drop=()):
        data = [(f"/in/{f}.csv", i, "DEBIT", "01/02/2025", f"row {i % 4}", f"{i}.00" if i else "", "ACH") for f in "abc" for i in range(6)]
        data += [("/in/unknown.csv", 0, "DEBIT", None, None, "", ""), ("/in/unknown.csv", 1, "DEBIT", None, None, "", "")]
        return rows([d for d in data if (d[0][4], d[1]) not in drop] + list(changes), ddl)

    files = rows([(1, "/in/a.csv"), (2, "/in/b.csv"), (3, "/in/c.csv")], "id bigint, file_path string")
    from rentroll.schemas import conform
    files = conform(files, FILE_PROCESSING.schema)
    order = ["source_file", "n"]
    first = bank.land_bank_export(export(drop=[("c", i) for i in range(6)]), files, 2025, order_by=order)
    marked = first.withColumn("is_processed", F.when(F.col("description") == "row 1", "Y").when(F.col("description") == "row 2", "N"))
    again = bank.land_files(export(drop=[("c", i) for i in range(6)]).orderBy(F.desc("n")), files, 2025, marked, order)
    assert {r["file_key"]: (r["rows"], r["action"]) for r in again.files.collect()} == {1: (6, "same"), 2: (6, "same"), -1: (2, "same")}
    assert again.landed.count() == 0 and sorted(again.staging.collect()) == sorted(marked.collect())
    # b loses a row, has one twice and one with a NULL where a text was; c is new; a is as it was
    more = [("/in/b.csv", 8, "DEBIT", "01/02/2025", "row 1", "1.00", "ACH"), ("/in/b.csv", 9, "DEBIT", "01/02/2025", "row 2", "2.00", None)]
    done = bank.land_files(export(more, drop=[("b", 2)]), files, 2025, marked, order)
    assert {r["file_key"]: r["action"] for r in done.files.collect()} == {1: "same", 2: "changed", 3: "new", -1: "same"}
    held = [r.asDict() for r in done.staging.collect()]
    assert len(held) == 6 + 7 + 6 + 2 and len({r["id"] for r in held}) == len(held)
    was = {r["id"]: tuple(r) for r in marked.collect() if r["file_id"] != 2}
    assert all(tuple(r.values()) == was[r["id"]] for r in held if r["file_id"] in (1, None))
    new = sorted((r for r in held if r["file_id"] in (2, 3)), key=lambda r: r["id"])
    assert [r["id"] for r in new] == list(range(15, 15 + 13))
    assert [(str(r["amount"]), r["is_processed"]) for r in new if r["file_id"] == 2] == [
        ("None", None), ("1.00", "Y"), ("3.00", None), ("4.00", None), ("5.00", "Y"), ("1.00", "Y"), ("2.00", None)]
    assert all(r["is_processed"] is None for r in new if r["file_id"] == 3)


def test_payments_need_a_year(spark, rows):
    from rentroll.operators.lookup import LoanRule
    from rentroll.plans import bank
    from rentroll.schemas import BANK_PAYMENT, PROPERTY, STAGING, conform

    staging = conform(rows([(1, "DEBIT", "LENDER x", "5.00", 2025), (2, "DEBIT", "LENDER y", "6.00", None), (3, "DEBIT", "LENDER z", None, 2025)],
                           "id bigint, details string, description string, amount string, year int"), STAGING.schema)
    done = bank.derive_loan_payments(staging, [LoanRule("LENDER")], rows([], PROPERTY.ddl), rows([], BANK_PAYMENT.ddl))
    assert [r["transaction_id"] for r in done.payments.collect()] == ["2025-BANKPAY-1"]
    assert {r["id"]: r["is_processed"] for r in done.staging.collect()} == {1: "Y", 2: "N", 3: "N"}


def test_notice_details(rows):
    when = dt.datetime(2025, 1, 2)
    mail = rows([(1, "Your BILL", "a@e", when), (2, "a bill", None, None), (3, "hello", "c@e", when), (4, "bill", "d@e", when)],
                "message_number bigint, subject string, `from` string, received_date timestamp")
    parts = rows([(1, 0, "text/plain", "abcdefgh", None, None, True), (1, 1, "text/html", "<p>ij</p>", None, None, True),
                  (1, 2, "image/png", "x", "Attachment", "p.png", True), (1, 5, None, None, "attachment", None, True),
                  (2, 0, "text/plain", None, "attachment", "no", False), (3, 0, "text/plain", "no", "attachment", "no", True), (None, 0, "text/plain", "no", None, None, True)],
                 "message_number bigint, part_no int, mime_type string, content string, disposition string, file_name string, multipart boolean")
    to = rows([(1, i, "To" if i != 1 else "Cc", f"r{i}") for i in range(5)] + [(3, 0, "To", "no"), (2, 0, None, "no")],
              "message_number bigint, place int, kind string, address string")
    got = messages.notice_details(mail, parts, to, ["bill"], chars_per_row=4, names_per_row=3)
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0, "Your BILL", "a@e", when, "abcd", ["p.png"], ["r0", "r2"]), (1, 1, None, None, None, "efgh", [None], ["r3", "r4"]),
        (1, 2, None, None, None, "ij", [], None), (2, 0, "a bill", None, None, "", None, None), (4, 0, "bill", "d@e", when, "", None, None)]
    assert messages.notice_details(mail, parts, to, []).count() == 0
