"""Text to dates, money and numbers. Unreadable text is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rentroll.schemas import MONEY

# English month abbreviations, as the lenient form looks them up.
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"
_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
_NAMED = r"^\d{1,2}-[A-Za-z]{3}-(\d{2}|\d{4})$"


def _slashed_date(c: Column) -> Column:
    """M/d/yyyy rearranged and cast; text of another form keeps its slash and casts to NULL."""
    return F.when(c.contains("/"), F.regexp_replace(c, _SLASHED, "$3-$1-$2").try_cast("date"))


def _full_year(c: Column, first_year: int) -> Column:
    """A two-digit year at the end becomes the one of the hundred years from ``first_year``."""
    short = F.right(c, F.lit(2))
    century = first_year // 100
    head = F.when(short >= f"{first_year % 100:02d}", F.lit(f"{century}")).otherwise(F.lit(f"{century + 1}"))
    return F.when(F.length(c) > 9, c).otherwise(F.concat(F.substr(c, F.lit(1), F.length(c) - 2), head, short))


def parse_date(c: Column, lenient: bool = False, first_year: int = 1946) -> Column:
    """ISO, then M/d/yyyy, then dd-MMM-yy, else NULL. ``c`` is trimmed text.

    ``lenient`` rolls overflowing days and months into the following months and
    ignores text after the date. Two-digit years lie in the hundred years from
    ``first_year``.
    """
    if lenient:
        return _parse_lenient(c, first_year)
    named = F.try_to_date(_full_year(c, first_year), "d-MMM-yyyy")
    # one look tells the forms apart, so each text is read once
    return F.when(c.contains("/"), _slashed_date(c)).when(c.rlike(_ISO), c.try_cast("date")).when(
        c.rlike(_NAMED), named
    )


def _rolled(y: Column, m: Column, d: Column) -> Column:
    first = F.make_date(F.greatest(y, F.lit(1)), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(first, (m - 1).cast("int")), (d - 1).cast("int"))


def _parse_lenient(c: Column, first_year: int) -> Column:
    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(c, pattern, i)

    def num(pattern: str, i: int) -> Column:
        return part(pattern, i).try_cast("int")

    iso = r"^(\d{4})-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])$"
    slashed = r"^(\d{1,4})/(\d{1,4})/(\d{1,4})"
    named = r"^(\d{1,4})-([A-Za-z]{3})-(\d{1,4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.lower(part(named, 2))).cast("int")
    year = num(named, 3)
    windowed = F.lit(first_year) + F.pmod(year - first_year, F.lit(100))
    full = F.when(F.length(part(named, 3)) == 2, windowed).otherwise(year)
    return (
        F.when(c.rlike(iso), _rolled(num(iso, 1), num(iso, 2), num(iso, 3)))
        .when(c.rlike(slashed), _rolled(num(slashed, 3), num(slashed, 1), num(slashed, 2)))
        .when(c.rlike(named) & (month > 0), _rolled(full, month, num(named, 1)))
    )


def parse_posting_date(c: Column, lenient: bool = False) -> Column:
    """M/d/yyyy, else NULL. ``c`` is trimmed text.

    ``lenient`` moves a day past the month's end back to its last day.
    """
    if not lenient:
        return _slashed_date(c)
    day = F.split_part(c, F.lit("/"), F.lit(2)).try_cast("int")
    first = F.regexp_replace(c, _SLASHED, "$3-$1-1").try_cast("date")
    clamped = F.when(day.between(1, 31), F.least(F.date_add(first, day - 1), F.last_day(first)))
    return F.when(c.rlike(_SLASHED), clamped)


def parse_money(c: Column) -> Column:
    """Drop thousands commas and dollar signs; two decimals, half up; too large is NULL.

    The cast itself skips outer blanks, as it does for whole numbers.
    """
    return F.translate(c, ",$", "").try_cast(MONEY)


def parse_whole(c: Column) -> Column:
    """A strict whole number, else NULL."""
    return c.try_cast("bigint")


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def number_after(c: Column, prefix: Column) -> Column:
    """The whole number that follows ``prefix``; NULL for other text."""
    return F.when(c.startswith(prefix), F.substr(c, F.length(prefix) + 1).try_cast("bigint"))


def rent_month(due: Column) -> Column:
    """English name of the month five days after the due date; blank without one."""
    return F.coalesce(F.date_format(F.date_add(due, 5), "MMMM"), F.lit(""))


def start_month(acquired: Column, year: Column, offset: int = 2) -> Column:
    """First month that can be vacant; 13 or more means none in ``year``."""
    return (
        F.when(acquired.isNull() | (F.year(acquired) < year), F.lit(1))
        .when(F.year(acquired) > year, F.lit(13))
        .otherwise(F.month(acquired) + F.lit(offset))
    )


def sequence_id(year: Column, label: str, seq: Column) -> Column:
    return F.concat(year.cast("string"), F.lit(f"-{label}-"), seq.cast("string"))
