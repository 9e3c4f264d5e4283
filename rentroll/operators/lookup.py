"""Name and key lookups, each as one left join that cannot fan out.

No side is broadcast by hint: the planner broadcasts a dimension whose size it
knows to be under ``spark.sql.autoBroadcastJoinThreshold`` and adaptive
execution splits hot keys of the other joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rentroll.functions.text import folded
from rentroll.operators.mutate import apart, one_per_key
from rentroll.operators.sequence import dense_sequence

PLACEHOLDER_ID = 0


def _names(dim: DataFrame, scope: Sequence[str], name: str, key: str) -> DataFrame:
    """One key (the lowest) for each folded name."""
    named = dim.filter(F.col(name).isNotNull()).groupBy(
        *[F.col(s).alias(f"_{s}") for s in scope], folded(F.col(name)).alias("_name")
    )
    return apart(named.agg(F.min(key).alias("_key")))


def resolve_property(df: DataFrame, properties: DataFrame, name: str, out: str = "property") -> DataFrame:
    """Property key by name, ignoring case; blank or unknown names get the placeholder."""
    keys = _names(properties, [], "name", "id")
    joined = df.join(keys, folded(F.col(name)) == F.col("_name"), "left")
    return joined.withColumn(out, F.coalesce("_key", F.lit(PLACEHOLDER_ID).cast("bigint"))).drop("_name", "_key")


def resolve_unit(
    df: DataFrame, units: DataFrame, name: str, property_col: str = "property", out: str = "unit",
    placeholder: Column | None = None,
) -> DataFrame:
    """Unit key by property and name; unknown is NULL.

    Rows of the placeholder property get ``placeholder``. It defaults to NULL,
    so that they do not refer to a unit that is not there.
    """
    keys = _names(units, ["property"], "name", "id")
    cond = (F.col(property_col) == F.col("_property")) & (folded(F.col(name)) == F.col("_name"))
    unknown = F.lit(None).cast("bigint") if placeholder is None else placeholder
    unit = F.when(F.col(property_col) == PLACEHOLDER_ID, unknown).otherwise(F.col("_key"))
    return df.join(keys, cond, "left").withColumn(out, unit).drop("_property", "_name", "_key")


def ensure_member(dim: DataFrame, key: str, values: dict) -> DataFrame:
    """Add the member ``values`` unless its key is present already."""
    member = dim.sparkSession.range(1).select(
        *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in dim.schema.fields]
    )
    there = dim.filter(F.col(key) == values[key]).select(key)
    return dim.unionByName(member.join(there, key, "left_anti"))


def ensure_placeholder_property(properties: DataFrame) -> DataFrame:
    """The member that stands for an unknown property."""
    return ensure_member(
        properties, "id",
        {"id": PLACEHOLDER_ID, "name": "Unknown Property", "full_address": "", "number_of_units": 0},
    )


def required_key(dim: DataFrame, name_col: str, key_col: str, name: str) -> int:
    """The key of one named member, read once per job; its absence is an error."""
    row = dim.filter(folded(F.col(name_col)) == name.strip().lower()).agg(F.min(key_col)).first()
    if row[0] is None:
        raise ValueError(f"{name_col} not found: {name}")
    return row[0]


def key_lookup(df: DataFrame, key: str, values) -> DataFrame:
    """Rows of one key, of a list of keys, or of the keys in a DataFrame."""
    if isinstance(values, DataFrame):
        return df.join(apart(values.select(key).distinct()), key, "left_semi")
    if isinstance(values, (list, tuple, set)):
        return df.filter(F.col(key).isin(list(values)))
    return df.filter(F.col(key) == values)


def latest_by_email(tenants: DataFrame) -> DataFrame:
    """One tenant for each email: the one with the highest key."""
    with_email = tenants.filter(F.col("email").isNotNull() & (F.col("email") != ""))
    return one_per_key(with_email, ["email"], ["tenant_id"], last=True).select(*tenants.columns)


@dataclass(frozen=True)
class LoanRule:
    """A lender's description prefix, an optional loan marker, and the property it pays for.

    Rules apply in list order. A rule without a marker catches the lender's other loans.
    """

    prefix: str
    marker: str | None = None
    property_name: str | None = None


def rule_prefixes(rules: Sequence[LoanRule]) -> list[str]:
    return list(dict.fromkeys(r.prefix for r in rules))


def loan_property_name(lender: Column, description: Column, rules: Sequence[LoanRule]) -> Column:
    """The property named by the first rule that applies; NULL leaves the placeholder.

    ``lender`` is the rule prefix found, in capitals.
    """
    out = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        applies = lender == rule.prefix.upper()
        if rule.marker:
            applies = applies & F.coalesce(F.upper(description).contains(rule.marker.upper()), F.lit(False))
        out = F.when(applies, F.lit(rule.property_name)).otherwise(out)
    return out


def collect_members(
    pairs: DataFrame, key: str, member: str, out: str, page_size: int = 10_000
) -> DataFrame:
    """(key, segment, list): each key's members in order, a row for each page of ``page_size``.

    The rule is the same for every key: a member's page is its place among the
    key's members, from 0, divided by the page size. Repeated pairs count once, and
    pairs that hold a NULL are left out. Places come from one global numbering, so
    no task holds more of a key than a page. Runs jobs when called.
    """
    pairs = pairs.select(key, member).filter(F.col(key).isNotNull() & F.col(member).isNotNull()).distinct()
    placed = dense_sequence(pairs, [key, member], name="_place", settle=True)
    first = apart(placed.groupBy(key).agg(F.min("_place").alias("_first")))
    page = F.floor((F.col("_place") - F.col("_first")) / page_size).cast("int")
    return (
        placed.join(first, key).withColumn("segment", page)
        .groupBy(key, "segment").agg(F.sort_array(F.collect_list(member)).alias(out))
    )
