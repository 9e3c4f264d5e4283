"""Cleaning and classifying of ledger and bank text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The wording of the source system's exports.
VOID_STATUSES = ("void", "waived")
CREDIT_CATEGORY = "credits"
DEPOSIT_APPLIED_PHRASES = ("security deposit applied", "deposit applied")
DEPOSIT_APPLIED_METHOD = "Deposit Applied"
TELLER_PHRASES = ("teller deposit at pnc", "teller", "pnc", "certified check")
TELLER_METHOD = "Teller Deposit"
RENT_CATEGORIES = ("rent", "prorated rent", "pet rent")
TYPE_NAMES = {"income / recurring monthly": "Recurring Monthly", "income / one time": "One Time"}
# category groups: the text before the slash
CHARGE_GROUP = "tenant charges & fees "
DEPOSIT_GROUP = "deposit "
RENT_GROUP = "rent "
REIMBURSED_FEES = ("water fee", "gas fee", "electricity fee")
PET_CHARGE = "pet charge"

# every character up to and including the space
_BLANKS = "".join(chr(i) for i in range(33))


def trimmed(c: Column) -> Column:
    """Strip blanks and control characters from both ends (plain ``trim`` strips spaces only)."""
    return F.btrim(c, F.lit(_BLANKS))


def clean_token(c: Column) -> Column:
    """Trim; a lone dash is NULL; blank stays blank."""
    return F.nullif(trimmed(c), F.lit("-"))


def clean_optional(c: Column) -> Column:
    """Trim; blank or a lone dash is NULL."""
    return F.nullif(F.nullif(trimmed(c), F.lit("")), F.lit("-"))


def empty_to_null(c: Column) -> Column:
    """Trim; blank is NULL; a dash is kept."""
    return F.nullif(trimmed(c), F.lit(""))


def folded(c: Column) -> Column:
    """The form in which names are compared."""
    return F.lower(trimmed(c))


def equals_ci(a: Column, b: Column | str) -> Column:
    """Equal but for case and outer blanks; NULL equals nothing."""
    other = F.lit(b.strip().lower()) if isinstance(b, str) else folded(b)
    return F.coalesce(folded(a) == other, F.lit(False))


def one_of_ci(c: Column, values: Sequence[str]) -> Column:
    return F.coalesce(folded(c).isin([v.lower() for v in values]), F.lit(False))


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Whether any phrase occurs, ignoring case; NULL holds none, and no phrases are never found."""
    if not phrases:
        return F.lit(False)
    if len(phrases) == 1:
        found = F.lower(c).contains(phrases[0].lower())
    else:
        # one pass over the text, and one small expression, for any number of phrases
        found = c.rlike("(?iu)" + "|".join(re.escape(p) for p in phrases))
    return F.coalesce(found, F.lit(False))


def normalize_type(c: Column) -> Column:
    t = trimmed(c)
    out = t
    for name, short in TYPE_NAMES.items():
        out = F.when(F.lower(t) == name, F.lit(short)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def category_group(category: Column) -> Column:
    """Lower-case text before the first slash, or the whole text without one."""
    return F.lower(F.substring_index(category, "/", 1))


def category_rest(category: Column, group: Column) -> Column:
    """Trimmed text after the slash that ends ``group``."""
    return trimmed(F.substr(category, F.length(group) + 2))


def grouped_category(category: Column, group: Column, rest: Column) -> Column:
    """The category without its group; pet charges are pet rent."""
    pet = (group == CHARGE_GROUP) & (F.lower(rest) == PET_CHARGE)
    known = group.isin(CHARGE_GROUP, DEPOSIT_GROUP, RENT_GROUP)
    return F.when(pet, F.lit("Pet Rent")).when(known, rest).otherwise(category)


def grouped_type(kind: Column, group: Column, rest: Column) -> Column:
    """The type, adjusted for utility fees and deposits."""
    fee = (group == CHARGE_GROUP) & F.lower(rest).isin(*REIMBURSED_FEES)
    return (
        F.when(fee, F.lit("Reimbursement")).when(group == DEPOSIT_GROUP, F.lit("Deposit")).otherwise(kind)
    )


def normalize_category(category: Column, kind: Column) -> tuple[Column, Column]:
    """(category without its group prefix, type adjusted for that group)."""
    cat = F.coalesce(trimmed(category), F.lit(""))
    group = category_group(cat)
    rest = category_rest(cat, group)
    return grouped_category(cat, group, rest), grouped_type(kind, group, rest)


def collapse_method(c: Column) -> Column:
    """``A, a`` becomes ``A`` when all listed methods agree; anything else is unchanged."""
    listed = F.regexp_replace(c, ",+$", "")
    parts = F.split(F.regexp_replace(folded(listed), "[\\x00-\\x20]*,[\\x00-\\x20]*", ","), ",")
    agree = (F.size(parts) > 1) & (F.size(F.array_distinct(parts)) == 1)
    # only lists pay for the split
    one = F.when(listed.contains(","), F.when(agree, trimmed(F.substring_index(listed, ",", 1))))
    return F.coalesce(one, c, F.lit(""))


def override_method(method: Column, details: Column) -> Column:
    """A phrase in the details names the method; a teller phrase wins over an applied deposit."""
    return (
        F.when(contains_any(details, TELLER_PHRASES), F.lit(TELLER_METHOD))
        .when(contains_any(details, DEPOSIT_APPLIED_PHRASES), F.lit(DEPOSIT_APPLIED_METHOD))
        .otherwise(method)
    )


def ledger_flags(final_method: Column, details: Column) -> tuple[Column, Column]:
    """(exclude flag, deposit-applied flag), each ``Y`` or blank."""
    applied = contains_any(details, DEPOSIT_APPLIED_PHRASES)
    exclude = F.when(applied | equals_ci(final_method, "cash"), F.lit("Y")).otherwise(F.lit(""))
    return exclude, F.when(applied, F.lit("Y")).otherwise(F.lit(""))


def kept_invoice(status: Column, category: Column) -> Column:
    """Neither voided nor a credit; a missing status or category is kept."""
    return ~one_of_ci(clean_token(status), VOID_STATUSES) & ~equals_ci(clean_token(category), CREDIT_CATEGORY)


def truncated(c: Column, n: int = 400) -> Column:
    return F.substring(c, 1, n)


def bank_name(description: Column) -> Column:
    """Text between the company marker and the id marker; NULL without a company marker."""
    pattern = "(?is)ORIG CO NAME:(.*?)(?:ORIG ID:|$)"
    found = F.contains(F.upper(description), F.lit("ORIG CO NAME:"))
    return F.when(found, trimmed(F.regexp_extract(description, pattern, 1)))


def trace_number(description: Column) -> Column:
    """The word carrying the TRN mark, or the word after a bare mark; else NULL."""
    return F.nullif(F.regexp_extract(description, "(?i)(?:^|\\s)TRN:\\s*(\\S+)", 1), F.lit(""))


def account_from_path(path: Column) -> Column:
    """``<bank>-<account>`` from a file named ``<bank>_<account>_…``; else the file name."""
    name = F.regexp_extract(path, "[^/\\\\]+$", 0)
    parts = F.split(F.regexp_replace(name, "_+$", ""), "_")
    joined = F.concat(trimmed(F.get(parts, F.lit(0))), F.lit("-"), trimmed(F.get(parts, F.lit(1))))
    return F.when(trimmed(path) != "", F.when(F.size(parts) > 1, joined).otherwise(name))


def leading(c: Column, prefixes: Sequence[str]) -> Column:
    """The first of ``prefixes`` (in capitals) that the text starts with, ignoring case; else NULL.

    One match for the whole list, so a description is looked at once. No prefixes give NULL.
    """
    if not prefixes:
        return F.lit(None).cast("string")
    pattern = "(?iu)^(?:" + "|".join(re.escape(p) for p in prefixes) + ")"
    return F.nullif(F.upper(F.regexp_extract(c, pattern, 0)), F.lit(""))


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    if not prefixes:
        return F.lit(False)
    return F.coalesce(c.rlike("(?iu)^(?:" + "|".join(re.escape(p) for p in prefixes) + ")"), F.lit(False))
