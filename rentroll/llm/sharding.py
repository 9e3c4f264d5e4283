"""Sharding by sampled splitters.

Rows are ordered by the hash of their text, then by id, so that copies lie together. A size-weighted
sample of those keys gives quantile boundaries; ranges that turn out overfull are sampled again and
subdivided. Exact sizes of the ranges then place every row: a shard is an equal slice of all bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentroll.session import durable

RANGES = 128  # ranges that the first sample aims at
SAMPLE_PER_RANGE = 32  # sampled keys for each range; at most about twice as many reach the driver
OVERFULL = 2.0  # times the mean size from which a range is subdivided
ROUNDS = 6


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """How many boundaries lie at or below a row's key."""
    if not bounds:
        return F.lit(0)
    at = F.array(*[F.struct(F.lit(k).cast("long").alias("_key"), F.lit(i).cast("long").alias("_id")) for k, i in bounds])
    return F.size(F.filter(at, lambda b: b <= F.struct("_key", "_id")))


def _sample(keyed: DataFrame, share: Column, seed: int) -> list[tuple[int, int]]:
    """Keys drawn with a chance of ``share``, the same ones whenever a task is run again."""
    chance = F.pmod(F.xxhash64("_key", "_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = keyed.filter((chance < share) & F.col("_id").isNotNull()).select("_key", "_id")
    return sorted({(r[0], r[1]) for r in drawn.collect()})


def range_shards(rows: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rows`` (id, text) as (id, size, text_crc32, shard, slot); each shard holds an equal share of the bytes.

    size: UTF-8 bytes of the text plus 1, a NULL text counting as none; text_crc32 of a NULL text is that of an
    empty one. Shard bounds fall where the running size passes a multiple of total / shards, so shards differ by
    one row's size at most. A NULL id sorts first; repeated rows get slots of their own; no rows give no rows.
    Only the key columns are shuffled, never the texts. Runs jobs when called.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = durable(
        rows.select(
            F.col(id_col).cast("long").alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_key"),
        ),
        "shard-keys",
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    want = RANGES * SAMPLE_PER_RANGE
    drawn = _sample(keyed, F.col("size") * (want / max(1, total)), 0)
    bounds = drawn[SAMPLE_PER_RANGE::SAMPLE_PER_RANGE]
    for round_ in range(1, ROUNDS + 1):
        ranged = keyed.withColumn("_range", _range_of(bounds))
        sizes = {r[0]: (r[1], r[2]) for r in ranged.groupBy("_range").agg(F.sum("size"), F.count("*")).collect()}
        mean = total / max(1, len(bounds) + 1)
        full = {r for r, (size, n) in sizes.items() if size > OVERFULL * mean and n > 1}
        if not full or round_ == ROUNDS:
            break
        heavy = ranged.filter(F.col("_range").isin(sorted(full)))
        more = _sample(heavy, F.col("size") * (SAMPLE_PER_RANGE / mean), round_)
        finer = sorted({*bounds, *more[SAMPLE_PER_RANGE // 2 :: SAMPLE_PER_RANGE // 2]})
        if finer == bounds:
            break
        bounds = finer
    rows_before, bytes_before, n, size = [], [], 0, 0
    for r in range(len(bounds) + 1):
        rows_before.append(n)
        bytes_before.append(size)
        more_bytes, more_rows = sizes.get(r, (0, 0))
        n, size = n + more_rows, size + more_bytes
    within = Window.partitionBy("_range").orderBy("_key", "_id")
    before = F.element_at(F.array(*[F.lit(x).cast("long") for x in bytes_before]), F.col("_range") + 1)
    rank = F.element_at(F.array(*[F.lit(x).cast("long") for x in rows_before]), F.col("_range") + 1)
    running = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = durable(
        ranged.select(
            "_id", "size", "text_crc32", (before + running).alias("_before"),
            (rank + F.row_number().over(within) - 1).alias("_rank"),
        ).select(
            "_id", "size", "text_crc32", "_rank",
            F.least(F.lit(shards - 1), F.floor(F.col("_before") * shards / F.lit(max(1, total)))).cast("int").alias("shard"),
        ),
        "shard-rows",
    )
    starts = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("_rank")).collect()}
    first = F.element_at(F.array(*[F.lit(starts.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_rank") - first).alias("slot"))
