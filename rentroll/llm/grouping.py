"""Best-fit packing by linear grouping: whole documents into as few sequences of fixed capacity as can be found.

Only the counts of the lengths 1 to capacity - 1 decide, so the plan is made from a table of that many rows whatever
the size of the corpus, and holds for ranks: "items 700 to 899 of length 512 go to sequences 40 to 239 at offset 1,024".

1. Large lengths, longest first, are cut into groups of equal numbers of items; each is rounded up to its group's
   longest.
2. With so few sizes, the multisets that fit a sequence (configurations) are optimised: the linear program over all of
   them by column generation, a knapsack finding the column that helps most. Whole numbers of each are used.
3. Groups hand their actual documents, longest first, to the configurations' places. Rounding leaves rooms, which are
   known exactly.
4. The group members that whole numbers left over, then the small documents, longest first, go each to the fullest
   sequence that has room for it, else to a new one.

A task numbers its pieces of each length; with the counts of the tasks before it, that is a piece's rank, which the
plan turns into its place. No text and no list of documents leaves the tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentroll.llm.packing import CAPACITY, crc, encoded, tokenizer
from rentroll.session import durable

END_ID = 0
#: Tried one after the other, the fewest sequences win: large is over capacity / share; so many groups.
SHARES, GROUPS = (2, 3, 5, 8), (24, 96)
CLOSE = 1.0005  # times the sequences that the bare sum of lengths needs: good enough to try no further
PIVOTS = 2000  # of the simplex method for one program; stopping early costs sequences, never correctness
#: Parts of a step: items [rank, rank + count) of a length, ``each`` of them side by side in every sequence from ``sequence`` on.
STEP = ("length", "rank", "count", "sequence", "each", "offset")


def fullest(capacity: int, sizes: np.ndarray, worth: np.ndarray) -> tuple[float, np.ndarray]:
    """The multiset of sizes of most worth within the capacity, by the number of its members; and that worth."""
    best, took = np.zeros(capacity + 1), []
    room = np.arange(capacity + 1)[:, None] - sizes[None, :]
    fits = room >= 0
    back = np.where(fits, room, 0)
    for _ in range(int(capacity // sizes.min())):
        value = np.where(fits, best[back] + worth[None, :], 0.0)
        pick = value.argmax(1)
        new = value[np.arange(capacity + 1), pick]
        if not (new > best + 1e-12).any():
            break
        took.append(np.where(new > best + 1e-12, pick, -1))
        best = np.maximum(best, new)
    counts, left = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(took):
        if pick[left] >= 0:
            counts[pick[left]] += 1
            left -= int(sizes[pick[left]])
    return float(best[capacity]), counts


def configurations(capacity: int, sizes: np.ndarray, demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Multisets of sizes and how often each is used whole: the optimum over all multisets, rounded down."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    used = inverse @ demand
    for _ in range(PIVOTS):
        worth = inverse.sum(0)  # every sequence costs 1
        value, counts = fullest(capacity, sizes, np.maximum(worth, 0.0))
        if value <= 1 + 1e-9:
            break
        step = inverse @ counts
        able = step > 1e-10
        if not able.any():
            break
        ratio = np.where(able, used / np.where(able, step, 1.0), np.inf)
        out = int(ratio.argmin())
        used = used - ratio[out] * step
        used[out] = ratio[out]
        columns[:, out] = counts
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    return [(columns[:, j].round().astype(np.int64), int(used[j] + 1e-7)) for j in range(m) if used[j] + 1e-7 >= 1]


def groups(counts: np.ndarray, large: int, number: int) -> list[list[tuple[int, int, int]]]:
    """Items of length ``large`` or more, longest first, in runs (length, rank, count) of equal numbers of items."""
    total = int(counts[large:].sum())
    out, bounds, placed = [], [total * (g + 1) // number for g in range(number)], 0
    for length in range(len(counts) - 1, large - 1, -1):
        rank, left = 0, int(counts[length])
        while left:
            while placed >= bounds[len(out) - 1] or not out:
                out.append([])
            take = min(left, bounds[len(out) - 1] - placed)
            out[-1].append((length, rank, take))
            rank, left, placed = rank + take, left - take, placed + take
    return [g for g in out if g]


def layout(counts: np.ndarray, capacity: int, share: int, number: int) -> tuple[int, list[tuple[int, ...]]]:
    """How many sequences, and the steps that place every item."""
    large = capacity // share + 1
    members = groups(counts, large, number)
    steps: list[tuple[int, ...]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (sequence, count), offset is capacity - room
    rooms: list[int] = []
    rest = [(length, 0, int(counts[length])) for length in range(1, large) if counts[length]]
    sequences = 0

    def add(room: int, sequence: int, count: int) -> None:
        if not free[room]:
            insort(rooms, room)
        free[room].append((sequence, count))

    if members:
        sizes = np.array([g[0][0] for g in members], np.int64)
        ahead = [list(reversed(g)) for g in members]  # next run last
        wanted = configurations(capacity, sizes, np.array([sum(r[2] for r in g) for g in members], float))
        for counted, times in sorted(wanted, key=lambda c: [-x for x in c[0]]):
            # runs of sequences that are alike so far: (first, count, used)
            alike = [(sequences, times, 0)]
            sequences += times
            for g, places in enumerate(counted.tolist()):
                for _ in range(places):
                    after = []
                    for first, count, used in alike:
                        while count and ahead[g]:
                            length, rank, there = ahead[g].pop()
                            put = min(count, there)
                            steps.append((length, rank, put, first, 1, used))
                            if put < there:
                                ahead[g].append((length, rank + put, there - put))
                            after.append((first, put, used + length))
                            first, count = first + put, count - put
                        if count:
                            after.append((first, count, used))
                    alike = after
            for first, count, used in alike:
                add(capacity - used, first, count)
        rest += [run for g in ahead for run in g]
    for length, rank, n in sorted(rest, reverse=True):
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                new = max(1, n // each)
                add(capacity, sequences, new)
                sequences += new
                at = len(rooms) - 1
            room = rooms[at]
            first, count = free[room].pop()
            if not free[room]:
                rooms.pop(at)
            each = min(room // length, n)
            full = min(count, n // each)
            if full < count:
                add(room, first + full, count - full)
            steps.append((length, rank, full * each, first, each, capacity - room))
            add(room - each * length, first, full)
            n, rank = n - full * each, rank + full * each
    return sequences, steps


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Steps (rows of ``STEP``) sorted by length and rank, of the trial with the fewest sequences."""
    best = None
    if counts.sum():
        least = -(-int(counts @ np.arange(len(counts))) // capacity)
        for share, number in ((s, n) for n in GROUPS for s in SHARES):
            got = layout(counts, capacity, share, number)
            if best is None or got[0] < best[0]:
                best = got
            if best[0] <= least * CLOSE:
                break
    steps = np.array(sorted(best[1]) if best else np.zeros((0, len(STEP))), np.int64)
    return steps.reshape(-1, len(STEP))


def place(steps: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of items by length and rank."""
    first = np.searchsorted(steps[:, 0], length, "left")
    last = np.searchsorted(steps[:, 0], length, "right")
    # within the steps of a length, ranks rise: one search over (length, rank) pairs
    pairs = np.empty(len(steps), dtype=[("length", np.int64), ("rank", np.int64)])
    pairs["length"], pairs["rank"] = steps[:, 0], steps[:, 1]
    wanted = np.empty(len(length), dtype=pairs.dtype)
    wanted["length"], wanted["rank"] = length, rank
    at = np.searchsorted(pairs, wanted, "right") - 1
    if ((at < first) | (at >= last)).any():
        raise ValueError("an item is not in the plan")
    step = steps[at]
    inside = rank - step[:, 1]
    return step[:, 3] + inside // step[:, 4], step[:, 5] + inside % step[:, 4] * length


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _task int, _nth bigint"


def pieces(rows: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) rows as ``PIECES``: ``_nth`` numbers a task's pieces of each length from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, nth = tokenizer(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(words, batch.column(1)), strict=True):
                ids = np.append(ids, np.uint16(END_ID))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((doc, k, start, len(part), crc(part), task, nth[len(part)]))
                    nth[len(part)] += 1
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_nth"])

    return rows.mapInArrow(cut, PIECES)


def pack_whole(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
               capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset); every sequence holds ``capacity`` ids at most.

    A document's ids are the tokenizer's without special ones added, then ``END_ID``; so a NULL or empty text is one
    id. Only longer documents are cut, into pieces of ``capacity`` ids and a last one that may be shorter; no piece is
    cut again. Repeated rows are documents of their own, rows of a NULL id are packed under NULL, other columns are
    left out, no rows give no pieces. Ties in length go by the order of tasks and of rows in a task; the pieces are
    stored before they are counted, so a lost executor changes none.

    Tokens are shared out to tasks by rows, so no key is hot; pieces of a length are ranked by counts of tasks, and one
    table of counts (a row for each length under ``capacity``) goes to the driver. The plan that comes back has some
    thousands of steps, bounded by lengths and trials, not by documents.
    """
    keyed = rows.select(rows[id_col].cast("long").alias("doc_id"), rows[text_col].cast("string").alias("text"))
    cut = durable(pieces(keyed, vocabulary, capacity), "pieces")
    told = durable(cut.groupBy("length", "_task").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in told.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    whole, counts[capacity] = int(counts[capacity]), 0
    steps = plan(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_task")) - F.col("n")
    ranked = cut.join(durable(told.select("length", "_task", before.alias("_before")), "ranks"), ["length", "_task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_nth") + F.col("_before")).alias("rank"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # whole pieces fill the first sequences
            sequence, offset = rank.copy(), np.zeros_like(rank)
            short = length < capacity
            sequence[short], offset[short] = place(steps, length[short], rank[short])
            sequence[short] += whole
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.mapInArrow(settle, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("doc_id", id_col)
