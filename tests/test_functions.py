import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rentroll.functions import markup, parse, text


def one(spark, expr_of, values, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {ddl}")
    return [r[1] for r in df.select("i", expr_of(F.col("c"))).orderBy("i").collect()]


def test_cleaning(spark):
    values = [" a\t", "-", "", None, " - "]
    assert one(spark, text.clean_token, values) == ["a", None, "", None, None]
    assert one(spark, text.clean_optional, values) == ["a", None, None, None, None]
    assert one(spark, text.empty_to_null, values) == ["a", "-", None, None, "-"]


def test_type_and_category(spark):
    values = ["Income / Recurring Monthly", "income / one time ", "Other", None]
    assert one(spark, text.normalize_type, values) == ["Recurring Monthly", "One Time", "Other", ""]
    pairs = [
        ("Tenant charges & fees / Water fee", "One Time", "Water fee", "Reimbursement"),
        ("Deposit / Pet charge", "One Time", "Pet charge", "Deposit"),
        ("Rent / January", "Recurring Monthly", "January", "Recurring Monthly"),
        ("Tenant charges & fees / Pet charge", "Recurring Monthly", "Pet Rent", "Recurring Monthly"),
        ("Rent", "", "Rent", ""),
        ("Laundry / coin", "One Time", "Laundry / coin", "One Time"),
    ]
    df = spark.createDataFrame(pairs, "cat string, kind string, want_cat string, want_kind string")
    cat, kind = text.normalize_category(F.col("cat"), F.col("kind"))
    assert df.filter((cat != F.col("want_cat")) | (kind != F.col("want_kind"))).count() == 0


def test_collapse_method(spark):
    values = ["ACH, ACH", "Other payment method, Other payment method", "ACH, CASH", "ACH,", "cash , Cash,,", ",", None]
    want = ["ACH", "Other payment method", "ACH, CASH", "ACH,", "cash", ",", ""]
    assert one(spark, text.collapse_method, values) == want


def test_method_and_flags(spark):
    df = spark.createDataFrame(
        [
            ("ACH", "Security Deposit APPLIED"), ("ACH", "deposit applied by teller"),
            ("ACH", "certified check"), (" cash ", None), ("ACH", "monthly"),
        ],
        "m string, d string",
    )
    method = text.override_method(F.col("m"), F.col("d"))
    got = df.select(method.alias("m"), "d").select("m", *text.ledger_flags(F.col("m"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [
        ("Deposit Applied", "Y", "Y"), ("Teller Deposit", "Y", "Y"), ("Teller Deposit", "", ""),
        (" cash ", "Y", ""), ("ACH", "", ""),
    ]


def test_bank_text(spark):
    values = ["orig co name:Lender A       ORIG ID:1  DESC", "ORIG CO NAME:Lender B", "nothing", None]
    assert one(spark, text.bank_name, values) == ["Lender A", "Lender B", None, None]
    values = ["pay TRN:12345", "x y z trn:ABC", "TRN:777 trailing words", "x y z", "TRN:", "x y TRN: ", "a TRN: 5", "xTRN:5"]
    assert one(spark, text.trace_number, values) == ["12345", "ABC", "777", None, None, None, "5", None]
    values = ["/in/Bank_0001_ALL_x.csv", "C:\\in\\Bank_0001.csv", "/in/plain.csv", "", None, "/in/Bank_"]
    want = ["Bank-0001", "Bank-0001.csv", "plain.csv", None, None, "Bank_"]
    assert one(spark, text.account_from_path, values) == want


def test_dates(spark):
    values = ["2025-1-5", "12/8/2025", "12/08/2025", "05-Jan-25", "5-jan-79", "05-Jan-2025", "2/30/2025", "13/45/2025",
              "1/2/25", "12/31/2025 10:00", "soon", None]
    d = dt.date
    assert one(spark, parse.parse_date, values) == [
        d(2025, 1, 5), d(2025, 12, 8), d(2025, 12, 8), d(2025, 1, 5), d(1979, 1, 5), d(2025, 1, 5),
        None, None, None, None, None, None,
    ]
    assert one(spark, lambda c: parse.parse_date(c, lenient=True), values)[:-2] == [
        d(2025, 1, 5), d(2025, 12, 8), d(2025, 12, 8), d(2025, 1, 5), d(1979, 1, 5), d(2025, 1, 5),
        d(2025, 3, 2), d(2026, 2, 14), d(25, 1, 2), d(2025, 12, 31),
    ]
    values = ["12/8/2025", "2/30/2025", "2025-01-05", "4/31/2025", "2/32/2025", ""]
    assert one(spark, parse.parse_posting_date, values) == [d(2025, 12, 8), None, None, None, None, None]
    assert one(spark, lambda c: parse.parse_posting_date(c, lenient=True), values) == [
        d(2025, 12, 8), d(2025, 2, 28), None, d(2025, 4, 30), None, None,
    ]


def test_money_and_numbers(spark):
    values = ["$1,234.565", "-0.005", "1e3", "(12)", "123456789.00", "", " 5 ", "$ 5", None]
    want = ["1234.57", "-0.01", "1000.00", None, None, None, "5.00", "5.00", None]
    assert one(spark, parse.parse_money, values) == [w and Decimal(w) for w in want]
    assert one(spark, parse.parse_whole, ["7", " 8 ", "L7", "7.5", None]) == [7, 8, None, None, None]
    tail = one(spark, lambda c: parse.number_after(c, F.lit("2025-Vacant-")), ["2025-Vacant-12", "2025-Vacant-x", "2024-Vacant-1"])
    assert tail == [12, None, None]


def test_rent_month_and_start(spark):
    d = dt.date
    assert one(spark, parse.rent_month, [d(2025, 1, 1), d(2025, 1, 28), None], "date") == ["January", "February", ""]
    values = [None, d(2024, 3, 10), d(2025, 3, 10), d(2026, 1, 1)]
    assert one(spark, lambda c: parse.start_month(c, F.lit(2025)), values, "date") == [1, 1, 5, 13]
    assert one(spark, lambda c: parse.start_month(c, F.lit(2025), 1), values, "date") == [1, 1, 4, 13]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<title>T</title><p>a</p><p>b<b>c</b></p>", "T a bc"),
        ("<script>var x='<p>';</script>x<br>y<!-- no -->", "x y"),
        ("a &amp; b &lt;i&gt; &#233;&#x41; &copy; &amp;lt;", "a & b <i> éA © &lt;"),
        ("  a \n&nbsp; b ", "a b"),
        ("1 < 2 &#xD800; &#abc;", "1 < 2 &#xD800; &#abc;"),
    ],
)
def test_html(spark, html, want):
    assert one(spark, markup.html_to_text, [html]) == [want]
