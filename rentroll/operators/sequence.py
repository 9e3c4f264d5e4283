"""Dense numbering without a single-task window.

Rows are placed once: range-partitioned and sorted by the order columns (or, for
file rows, left where the scan found them). A row's number is then the count of
the rows in earlier partitions plus its position in its own, so a third of all
rows sharing one leading key still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rentroll.functions.parse import number_after
from rentroll.session import durable


def _number(placed: DataFrame, group_by: list[str], span: list[str], position: str, name: str,
            start: DataFrame | None) -> DataFrame:
    spans = placed.groupBy(*group_by, *span).agg(
        F.min(position).alias("_lo"), F.count(F.lit(1)).alias("_n")
    )
    # one row per partition and group: the running sum sees counts, never data
    earlier = Window.partitionBy(*group_by).orderBy(*span).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if start is not None:
        on = group_by or None
        spans = (spans.join(start, on, "left") if on else spans.withColumn("_last", F.lit(_scalar(start))))
        spans = spans.withColumn("_before", F.col("_before") + F.coalesce(F.col("_last"), F.lit(0)))
    spans = spans.select(*group_by, *span, (F.col("_before") - F.col("_lo") + 1).alias("_shift"))
    # stored, its size is known, so the planner itself decides whether it may be broadcast
    spans = durable(spans, "spans")
    at = placed.alias("rows").join(
        spans.alias("spans"), [F.col(f"rows.{c}").eqNullSafe(F.col(f"spans.{c}")) for c in [*group_by, *span]])
    return at.select("rows.*", "_shift").withColumn(name, F.col(position) + F.col("_shift")).drop(*span, position, "_shift")


def _scalar(start: DataFrame):
    row = start.agg(F.max("_last")).first()
    return int(row[0]) if row and row[0] is not None else 0


def dense_sequence(
    df: DataFrame,
    order_by: Sequence[str],
    group_by: Sequence[str] = (),
    start: DataFrame | None = None,
    name: str = "seq",
    settle: bool = False,
) -> DataFrame:
    """Number rows 1, 2, 3 … by ``order_by`` within each ``group_by``.

    ``order_by`` must identify rows within a group. ``start`` holds the group
    columns and ``_last``, the highest number already given. Groups are meant to
    be few (years); their size is not limited. ``settle`` stores the rows first:
    range partitioning reads its input twice, which is dear where few rows are
    left of much that was scanned, or where the rows were costly to parse.
    """
    keys = [*group_by, *order_by]
    if settle:
        df = durable(df, "settled")
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # the range bounds are sampled, so both later reads must share one placement
    placed = durable(placed, "placed")
    return _number(placed, list(group_by), ["_task"], "_at", name, start)


def number_file_rows(
    df: DataFrame,
    file_col: str = "source_file",
    block_col: str = "line_block",
    line_col: str = "line_at",
    last: int = 0,
    name: str = "id",
) -> DataFrame:
    """Number scanned rows in file order; moves no rows.

    A scan gives each row its file, its split's offset and a position rising
    within the split; rows are ranked in their split, and counts per split do the rest.
    """
    placed = durable(
        df.withColumn("_file", F.col(file_col)).withColumn("_block", F.col(block_col))
        .withColumn("_line", F.col(line_col)),
        "scanned",
    )
    # positions have gaps where the scan left records out; a split is bounded, so its rows can be ranked
    placed = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_line"))).drop("_line")
    start = df.sparkSession.range(1).select(F.lit(last).cast("bigint").alias("_last"))
    return _number(placed, [], ["_file", "_block"], "_at", name, start)


def running_total(df: DataFrame, order_by: str, amount: str, group_by: Sequence[str], block: int = 1000, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``amount`` over the earlier rows of its group, 0 for the first.

    ``order_by`` is a whole number. Groups may be of any size: sums run within blocks of ``block`` order numbers, and the
    totals of a group's blocks, one narrow row each, place the blocks. Rows move once, by group and block. Rows of one
    number follow each other in any order. A NULL amount adds nothing; a NULL order number stands in a block before
    others. ``df`` is read twice, so store it first where it is dear to compute.
    """
    keys = [*group_by, "_block"]
    blocked = df.withColumn("_block", F.floor(F.col(order_by) / block))
    within = Window.partitionBy(*keys).orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group_by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    totals = totals.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    rows = blocked.withColumn("_inner", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    at = rows.alias("rows").join(totals.alias("totals"), [F.col(f"rows.{c}").eqNullSafe(F.col(f"totals.{c}")) for c in keys])
    return at.select("rows.*", (F.col("_inner") + F.col("_earlier")).alias(name)).drop("_block", "_inner")


def next_number(ids: Column, prefix: Column) -> Column:
    """Aggregate: the number after the highest one used with ``prefix``; 1 at first."""
    return F.coalesce(F.max(number_after(ids, prefix)), F.lit(0)) + 1


def last_numbers_by_year(df: DataFrame, id_col: str, label: str) -> DataFrame:
    """(year, _last): the highest ``<year>-<label>-<n>`` in use for each year."""
    pattern = rf"^(\d{{1,9}})-{label}-(\d{{1,18}})$"
    ids = df.select(F.col(id_col).alias("_id")).filter(F.col("_id").contains(f"-{label}-"))
    return (
        ids.select(
            F.regexp_extract("_id", pattern, 1).try_cast("int").alias("year"),
            F.regexp_extract("_id", pattern, 2).try_cast("bigint").alias("_last"),
        )
        .filter(F.col("year").isNotNull() & F.col("_last").isNotNull())
        .groupBy("year")
        .agg(F.max("_last").alias("_last"))
    )


def surrogate_keys(
    new_members: DataFrame, order_by: Sequence[str], existing: DataFrame, key: str
) -> DataFrame:
    """Give each new member the next free key after the highest in ``existing``."""
    start = existing.agg(F.max(key).alias("_last"))
    return dense_sequence(new_members, order_by, start=start, name=key)
