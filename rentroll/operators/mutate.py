"""Table mutation as new table states: append, upserts, deletes, updates, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rentroll.session import durable


def apart(unique: DataFrame) -> DataFrame:
    """Let an aggregated side enter a join through a shuffle of its own.

    Adaptive execution splits a hot key of the other side only where both sides
    come straight from a shuffle; a join that reuses the aggregation's shuffle
    would put all rows of the key into one task.
    """
    return unique.hint("rebalance")


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Bag union by column name; either side may lack columns."""
    return target.unionByName(rows, allowMissingColumns=True)


#: Decimal digits of an order that is packed with the row's mark into one number of fixed width.
_MARK = 10**19
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _place(df: DataFrame, order_by: Sequence[str]) -> Column:
    """What rows of a key are compared by: the order, then a hash of the whole row where that is equal.

    One integral column and the hash make a number of fixed width, which aggregates by hash; other orders
    make a struct. NULLs come first.
    """
    mark = F.xxhash64(*df.columns)
    if len(order_by) > 1 or dict(df.dtypes)[order_by[0]] not in _INTEGRAL:
        return F.struct(*order_by, mark.alias("_mark"))
    order = F.coalesce(F.col(order_by[0]).cast("decimal(38,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(38,0)"))
    return order * F.lit(str(_MARK)).cast("decimal(38,0)") + F.pmod(mark, F.lit(2**63 - 1)).cast("decimal(38,0)")


def one_per_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order_by``; of rows equal in it one, chosen by its content.

    Two phases: only keys and places are reduced, each task reducing its own rows first, and the
    rows at the places found are then taken in a join. So no full row is sorted or held by an
    aggregation; a key holding a third of the table moves one place per task, and its rows
    are spread in the join by their places. Rows that are equal throughout are one row.
    """
    key = list(key)
    rows = df.withColumn("_place", _place(df, order_by))
    best = rows.groupBy(*key).agg((F.max if last else F.min)("_place").alias("_best"))
    best = best.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)], "_best")
    at = [rows[k].eqNullSafe(best[f"_key_{i}"]) for i, k in enumerate(key)]
    return rows.join(best, [*at, rows["_place"] == best["_best"]], "left_semi").select(*df.columns).distinct()


def full_upsert(
    target: DataFrame, rows: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """Whole rows replace those with the same key; others are added.

    With ``order_by`` the last of several incoming rows of a key wins; without it
    incoming keys must be unique.
    """
    key = list(key)
    if order_by:
        rows = one_per_key(rows, key, order_by, last=True)
    rows = rows.select(*[c for c in rows.columns if c in target.columns])
    return append(target.join(rows.select(*key), key, "left_anti"), rows).select(*target.columns)


def partial_upsert(
    target: DataFrame,
    rows: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Only ``columns`` change on a match; a new key gets NULL in the others."""
    key = list(key)
    if order_by:
        rows = one_per_key(rows, key, order_by, last=True)
    source = rows.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = target.join(source, key, "full_outer")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ]
    )


class GuardedUpsert(NamedTuple):
    table: DataFrame
    actions: DataFrame  # key, scope, existing_scope, action: insert | update | skip | conflict


def guarded_upsert(
    target: DataFrame,
    batch: DataFrame,
    key: str,
    scope: str,
    order_by: Sequence[str],
    overwrite: bool = False,
    settle: bool = False,
) -> GuardedUpsert:
    """Upsert that refuses to touch a key recorded under another ``scope`` (year).

    Same scope: the stored row stays, or is replaced when ``overwrite`` is on.
    Within the batch the first row of a key counts, or the last with
    ``overwrite``. Rows whose key is NULL or blank are left out. ``settle`` stores
    the batch's rows with their actions, for callers that use both results.
    """
    carried = list(dict.fromkeys([*target.columns, *order_by]))
    usable = batch.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    unique = one_per_key(usable.select(*carried), [key], order_by, last=overwrite)
    stored = target.select(F.col(key), F.col(scope).alias("existing_scope"), F.lit(True).alias("_stored"))
    known = unique.join(stored, key, "left")
    action = (
        F.when(F.col("_stored").isNull(), F.lit("insert"))
        .when(~F.col("existing_scope").eqNullSafe(F.col(scope)), F.lit("conflict"))
        .otherwise(F.lit("update" if overwrite else "skip"))
    )
    known = known.withColumn("action", action)
    if settle and not overwrite:
        known = durable(known, "known")
    actions = known.select(key, F.col(scope).alias("scope"), "existing_scope", "action")
    incoming = known.filter(F.col("action").isin("insert", "update")).select(*target.columns)
    if not overwrite:
        return GuardedUpsert(target.unionByName(incoming).select(*target.columns), actions)
    # keys are unique on both sides: one outer join gives the new table, and the batch is reduced once for it
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    old = target.select(F.col(key).alias("_key"), F.struct(*target.columns).alias("_old"))
    new = unique.select(F.col(key).alias("_key"), F.struct(*typed).alias("_new"))
    same = F.col(f"_old.{scope}").eqNullSafe(F.col(f"_new.{scope}"))
    replaced = F.col("_new").isNotNull() & (F.col("_old").isNull() | same)
    both = old.join(new, "_key", "full_outer")
    table = both.select(F.when(replaced, F.col("_new")).otherwise(F.col("_old")).alias("_row")).select("_row.*")
    return GuardedUpsert(table, actions)


def require_no_conflicts(actions: DataFrame) -> None:
    """Raise when a batch row would change a key of another year."""
    bad = actions.filter(F.col("action") == "conflict").limit(1).collect()
    if bad:
        raise ValueError(f"attempt to modify a row outside its year: {bad[0].asDict()}")


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop rows the predicate holds for; an unknown outcome keeps the row."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def update_column(target: DataFrame, outcomes: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Set ``column`` from ``outcomes`` where it gives a value; other rows keep theirs."""
    key = list(key)
    new = outcomes.select(*key, F.col(column).alias("_new"))
    joined = target.join(new, key, "left")
    return joined.withColumn(column, F.coalesce("_new", column)).select(*target.columns)


def update_by_key(
    target: DataFrame, rows: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """Replace whole rows of keys that exist; never inserts."""
    key = list(key)
    return full_upsert(target, rows.join(target.select(*key), key, "left_semi"), key, order_by)


def distinct_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations in which no column is NULL."""
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    return df.filter(present).select(*columns).distinct()
