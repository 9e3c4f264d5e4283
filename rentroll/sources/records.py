"""Records of delimited text files whose quoted values may hold line breaks, without reading a file in one task.

Files are read line by line, in splits as any text is. What a line does to the reader's state (where it starts outside
a quoted value, does it leave one open; and where it starts inside one?) is a function of two states, and such functions
compose. A first reading composes them over the lines of each split, where they are; a window over the splits of each
file, of which there are few, tells the state in which a split starts. With that a second reading puts records together
where their lines lie. Only lines of records that span splits, or are too long to be one, are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rentroll.session import durable

SPLIT = ("source_file", "line_block")
LINE = (*SPLIT, "line_at")
#: A quoted value that never ends would gather the rest of its file; beyond so many lines its lines are rejected one by one.
RECORD_LINES = 10_000
#: Functions of the state, as (from outside, from inside): keeps it, turns it, always outside, always inside.
SAME, TURNED, OUTSIDE, INSIDE = range(4)
#: Whole values with their commas, then one that a quote opens and none closes. Possessive, so no text is tried twice.
_OPEN = r'^(?>(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+,)*+"[^"]*+(?:""[^"]*+)*+$'


def line_effect(line: Column) -> Column:
    """What a line does to the state; a line without a quote keeps it."""
    opens, stays = line.rlike(_OPEN), F.concat(F.lit('"'), line).rlike(_OPEN)
    effect = (
        F.when(~line.contains('"'), SAME)
        .when(opens & ~stays, TURNED).when(~opens & ~stays, OUTSIDE).when(opens & stays, INSIDE).otherwise(SAME)
    )
    return effect.cast("tinyint")


def any_open_line(spark: SparkSession, path: str, glob: str) -> bool:
    """Whether any line leaves a quoted value open; where none does, every line is a record."""
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    return not lines.filter(F.col("value").contains('"') & F.col("value").rlike(_OPEN)).isEmpty()


def read_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(source_file, line_block, line_at, line, effect) as scanned: the lines of a split follow each other in one task,
    and positions rise within it."""
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("line_block"),
        F.monotonically_increasing_id().alias("line_at"), F.col("value").alias("line"))
    return lines.withColumn("effect", line_effect(F.col("line")))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str, int]]:
    """(first row, row after the last, source_file, line_block) of the runs of lines of one split."""
    if not batch.num_rows:
        return
    file, block = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    code = file.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield low, high, file.dictionary[int(code[low])].as_py(), int(block[low])


def _states(effects: np.ndarray, start: int) -> np.ndarray:
    """The state after each line, 1 inside a quoted value: turns count from the last line that does not look at it."""
    turns = np.cumsum(effects == TURNED)
    fixed = np.maximum.accumulate(np.where(effects >= OUTSIDE, np.arange(len(effects)), -1))
    since = (effects[fixed] == INSIDE) + turns - turns[fixed]
    return np.where(fixed >= 0, since, start + turns) & 1


def _composed(lines: DataFrame) -> DataFrame:
    """(source_file, line_block, fixed, turns), a row for each split: the state it ends in whatever it starts in, or
    else whether it turns it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fixed, turns, done = None, None, 0, []
        for batch in batches:
            effects = batch.column(2).to_numpy()
            for low, high, *split in _runs(batch):
                if split != at:
                    if at:
                        done.append((*at, fixed, turns))
                    at, fixed, turns = split, None, 0
                some = effects[low:high]
                end = int(_states(some, turns if fixed is None else fixed)[-1])
                if fixed is not None or (some >= OUTSIDE).any():
                    fixed, turns = end, 0
                else:
                    turns = end
        if at:
            done.append((*at, fixed, turns))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["source_file", "line_block", "fixed", "turns"])

    return lines.select(*SPLIT, "effect").mapInArrow(run, "source_file string, line_block bigint, fixed int, turns int")


def inside_splits(lines: DataFrame) -> DataFrame:
    """(source_file, line_block) of the splits that start inside a quoted value."""
    splits = durable(_composed(lines), "splits")  # one row per split; the splits of one file are few
    by_place = Window.partitionBy("source_file").orderBy("line_block")
    summed = splits.withColumn("all_turns", F.sum("turns").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    fixing = F.when(F.col("fixed").isNotNull(), F.struct(F.col("fixed").alias("inside"), F.col("all_turns").alias("turns")))
    last = F.last(fixing, ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    known = summed.withColumns({"last": last, "turned": F.coalesce(F.lag("all_turns").over(by_place), F.lit(0))})
    start = (F.coalesce("last.inside", F.lit(0)) + F.col("turned") - F.coalesce("last.turns", F.lit(0))) % 2
    return known.filter(start == 1).select(*SPLIT)


def placed_records(lines: DataFrame) -> DataFrame:
    """(source_file, line_block, line_at, text, first_block, first_at, piece), stored: records whose lines lie in one
    split, at the place of their first line; and as pieces the lines of others, with the place of the record's first
    line where it lies in the split."""
    inside = {tuple(r) for r in inside_splits(lines).collect()}  # at most one for each split, as the scan itself lists
    held, limit = lines.sparkSession.sparkContext.broadcast(inside), RECORD_LINES
    names = [*LINE, "text", "first_block", "first_at", "piece"]

    def made(split: list, at: pa.Array, text: pa.Array, first: int | None, piece: bool) -> pa.RecordBatch:
        n, number = len(at), pa.int64()
        file, block = split
        opened = [pa.nulls(n, number)] * 2 if first is None else [pa.repeat(pa.scalar(x, number), n) for x in (block, first)]
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(file, pa.string()), n), pa.repeat(pa.scalar(block, number), n), at, text, *opened,
             pa.repeat(pa.scalar(piece), n)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state = None, 0
        first, waiting, many = None, [], 0  # the open record: place of its first line if that lies here, lines, their number
        for batch in batches:
            effects = batch.column(4).to_numpy()
            for low, high, *here in _runs(batch):
                if here != split:
                    yield from (made(split, *part, first, True) for part in waiting)
                    split, state = here, int(tuple(here) in held.value)
                    first, waiting, many = None, [], 0
                at, text = batch.column(2).slice(low, high - low), batch.column(3).slice(low, high - low)
                after = _states(effects[low:high], state)
                starts = np.flatnonzero(np.concatenate(([state], after[:-1])) == 0)
                state, n = int(after[-1]), high - low
                going_on = int(starts[0]) if len(starts) else n
                if going_on:
                    waiting.append((at.slice(0, going_on), text.slice(0, going_on)))
                    many += going_on
                    ended = not after[going_on - 1]
                    if ended and first is not None and many <= limit:
                        whole = pc.binary_join(pa.array([[v for _, t in waiting for v in t.to_pylist()]], pa.list_(pa.string())), "\n")
                        yield made(split, pa.array([first], pa.int64()), whole, None, False)
                        waiting = []
                    if ended or first is None or many > limit:
                        yield from (made(split, *part, first, True) for part in waiting)
                        waiting = []
                    if ended:
                        first, many = None, 0
                if not len(starts):
                    continue
                ends = np.append(starts[1:], n)
                if state:  # the last record goes on
                    a = int(starts[-1])
                    starts, ends = starts[:-1], ends[:-1]
                if len(starts):
                    offsets = np.append(starts, ends[-1]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text)
                    fits = ends - starts <= limit
                    yield made(split, at.take(pa.array(starts[fits])), pc.binary_join(lists, "\n").filter(pa.array(fits)), None, False)
                    for b, e in zip(starts[~fits].tolist(), ends[~fits].tolist(), strict=True):
                        yield made(split, at.slice(b, e - b), text.slice(b, e - b), at[b].as_py(), True)
                if state:
                    first, waiting, many = at[a].as_py(), [(at.slice(a), text.slice(a))], n - a
                    if many > limit:
                        yield made(split, *waiting[0], first, True)
                        waiting = []
        yield from (made(split, *part, first, True) for part in waiting)

    schema = "source_file string, line_block bigint, line_at bigint, text string, first_block bigint, first_at bigint, piece boolean"
    stored = durable(lines.select(*LINE, "line", "effect").mapInArrow(run, schema), "records")
    held.destroy()
    return stored


def assembled(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (source_file, line_block, line_at, record) at the place of their first line, and the lines
    (source_file, record) of those that are too long to be one."""
    alone = placed.filter(~F.col("piece")).select(*LINE, F.col("text").alias("record"))
    pieces = placed.filter("piece")
    opener = F.when(F.col("first_at").isNotNull(), F.struct("first_block", "first_at"))
    splits = pieces.groupBy(*SPLIT).agg(F.max(opener).alias("opened"))
    # a record that goes on from an earlier split began at the last opener before this split
    earlier = Window.partitionBy("source_file").orderBy("line_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = durable(splits.select(*SPLIT, F.last("opened", ignorenulls=True).over(earlier).alias("carried")), "carried")
    if carried.isEmpty():
        return alone, pieces.select("source_file", F.col("text").alias("record"))
    first = F.coalesce(opener, F.col("carried"))
    owned = pieces.join(carried, list(SPLIT)).select(
        *LINE, "text", first["first_block"].alias("first_block"), first["first_at"].alias("first_at"))
    key = ["source_file", "first_block", "first_at"]
    counts = durable(owned.groupBy(*key).agg(F.count("*").alias("n")), "counts")
    owned = owned.join(counts, key)
    parts = F.sort_array(F.collect_list(F.struct("line_block", "line_at", "text")))
    glued = owned.filter(F.col("n") <= RECORD_LINES).groupBy(*key).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("record"))
    glued = glued.select("source_file", F.col("first_block").alias("line_block"), F.col("first_at").alias("line_at"), "record")
    return alone.unionByName(glued), owned.filter(F.col("n") > RECORD_LINES).select("source_file", F.col("text").alias("record"))


def records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of lines as ``read_lines`` gives them, and the lines of those that are too long to be one."""
    return assembled(placed_records(lines))


def first_lines(placed: DataFrame) -> DataFrame:
    """(source_file, line_block, line_at) of each file's first line that is not blank."""
    there = placed.filter(F.trim("text") != "").groupBy("source_file").agg(F.min(F.struct("line_block", "line_at")).alias("at"))
    return there.select("source_file", "at.*")
