"""Conversations repaired to ``(s?(ua)+)?`` by the cheapest edits, found with a dynamic program that is checkpointed.

A conversation's turns are read as one symbol each: the class of the role's initial and the turn's first fault. The
program goes over the symbols from the last to the first and keeps, for each of four states, the least cost of what is
still to come. Only every sqrt(n)-th of these vectors is kept; walking forward, a block's vectors are made anew from
the checkpoint behind it, and the walk takes in each state the ASCII-least edit that is tight. So n turns need
2 sqrt(n) vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentroll.session import durable

WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
EVERY = 20  # kinds of damage by remainder
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5  # costs
CLASSES, ROLES = "sua", {"u": "user", "a": "assistant"}
FINE, CUT, BLANK, TWICE = range(4)  # a turn's first fault
SYMBOLS = "abcdefghijklmnop"  # class (three initials and any other) + 4 * fault
BLOCK_TURNS = 4096  # symbols put together before a conversation's are
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. The state after a role:
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a changed or new turn gets, and the state after it.
DUE = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
FINAL = (0, None, None, 0)  # cost at the end of the turns, before insertions
FAR = 1 << 60


def _choices() -> dict[str, list[list[tuple[str, int, int]]]]:
    """For each symbol and state the edits of a turn, ASCII order: (edit, cost, state after)."""
    out = {}
    for code, symbol in enumerate(SYMBOLS):
        kind, fault = code % 4, code // 4
        initial = CLASSES[kind] if kind < 3 else None
        more = TRUNCATED if fault == CUT else 0
        out[symbol] = []
        for state in range(4):
            edits = [("D", DELETE, state)]
            if fault not in (BLANK, TWICE):
                if initial in NEXT[state]:
                    edits.append(("K", more, NEXT[state][initial]))
                if initial != DUE[state][0]:
                    edits.append(("R", REROLE + more, DUE[state][1]))
            out[symbol].append(edits)
    return out


CHOICES = _choices()


def inserted(costs: list[int]) -> list[int]:
    """Costs when turns may be inserted first; a third insertion would be back in the state of the first."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[DUE[s][1]]) for s, c in enumerate(costs)]
    return costs


def before(symbol: str, costs: list[int]) -> list[int]:
    """The vector before a turn, from the one after it."""
    return inserted([min(cost + costs[then] for _, cost, then in edits) for edits in CHOICES[symbol]])


def cheapest(symbols: str) -> tuple[int, str]:
    """The least cost and the ASCII-least string of edits (Delete, Insert, Keep, Rerole) that has it."""
    n = len(symbols)
    step = max(1, isqrt(n))
    last = inserted([FAR if c is None else c for c in FINAL])
    checkpoints, costs = {n: last}, last
    for i in range(n - 1, -1, -1):
        costs = before(symbols[i], costs)
        if i % step == 0:
            checkpoints[i] = costs
    total, state, audit = costs[0], 0, []

    def inserts(here: list[int], state: int, edits: list[tuple[str, int, int]], after: list[int] | None) -> int:
        """Insertions come before Keep and Rerole, and after Delete, in ASCII order."""
        while True:
            if after is not None and any(e == "D" and c + after[t] == here[state] for e, c, t in edits[state]):
                return state
            if INSERT + here[DUE[state][1]] != here[state]:
                return state
            audit.append("I")
            state = DUE[state][1]

    for low in range(0, n, step):
        high = min(low + step, n)
        block = [checkpoints[high]]
        for i in range(high - 1, low - 1, -1):
            block.append(before(symbols[i], block[-1]))
        block.reverse()
        for i in range(low, high):
            here, after, edits = block[i - low], block[i - low + 1], CHOICES[symbols[i]]
            state = inserts(here, state, edits, after)
            edit, _, state = next(e for e in edits[state] if e[1] + after[e[2]] == here[state])
            audit.append(edit)
    inserts(last, state, [], None)
    return total, "".join(audit)


def illegal(symbols: str) -> int:
    """Neighbouring turns whose roles' initials are not su, ua or au."""
    kinds = [SYMBOLS.index(s) % 4 for s in symbols]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(kinds, kinds[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows with NULLs read as one space, damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 repeats the row
    (``copy`` 1), 4 makes it a user's.
    """
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % EVERY
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(copies).alias("copy"))


def placed_turns(rows: DataFrame) -> DataFrame:
    """Turns in order of (turn, role, text, copy), NULLs first, over many tasks: a conversation may lie in several.

    Bounds of ranges are sampled, so the rows are stored once with their places.
    """
    keys = ["conv_id", "turn", "role"]
    at = rows.repartitionByRange(*keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text", "copy")
    at = at.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    return durable(at, "turns")


def symbol_rows(placed: DataFrame) -> DataFrame:
    """(conv_id, task, at, symbol): the turn's class and first fault: blank, seen earlier, truncated, in this order."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("\0"),
                                  F.length("role").cast("string"), F.lit("\0"), F.col("role"), F.col("text")), 256))
    kind = F.lit(4)
    for n, initial in enumerate(CLASSES, 1):
        kind = F.when(F.col("role").startswith(initial), n).otherwise(kind)
    known = placed.select(
        "conv_id", "task", "at", kind.alias("kind"),
        F.when(bare == "", F.lit(BLANK)).when(F.right(bare, F.lit(1)).isin(*ENDS), F.lit(FINE)).otherwise(F.lit(CUT)).alias("fault"),
        F.when(bare != "", key).alias("key"))
    known = durable(known, "faults")
    # only texts that are there twice or more take part in the join
    first = known.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("task", "at")).alias("first"), F.count("*").alias("n"))
    first = durable(first.filter("n > 1").select("key", "first"), "twice")
    marked = known.join(first, "key", "left")
    fault = F.when(F.col("first") < F.struct("task", "at"), F.lit(TWICE)).otherwise(F.col("fault"))
    return marked.select("conv_id", "task", "at", F.substring(F.lit(SYMBOLS), (F.col("kind") + 4 * fault).cast("int"), F.lit(1)).alias("symbol"))


def in_order(cells: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """The texts of a key put together in order."""
    got = F.sort_array(F.collect_list(F.struct(*order, text)))
    return cells.groupBy(*keys).agg(F.array_join(F.transform(got, lambda x: x[text]), "").alias(text))


def audits(placed: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has turns."""
    blocks = symbol_rows(placed).withColumn("block", F.floor(F.col("at") / BLOCK_TURNS))
    whole = in_order(in_order(blocks, ["conv_id", "task", "block"], ["at"], "symbol"), ["conv_id"], ["task", "block"], "symbol")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                faults = [sum(symbols.count(s) for s in SYMBOLS[4 * f : 4 * f + 4]) for f in (BLANK, TWICE, CUT)]
                out.append((conv, *faults, illegal(symbols), *cheapest(symbols)))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.string()]
            names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    return durable(whole.select("conv_id", "symbol").mapInArrow(judge, schema), "audits")


def _stream(placed: DataFrame, audit: DataFrame) -> DataFrame:
    """A conversation's audit, then its turns in order, in one task; sorted on disk where they are many."""
    head = audit.select("conv_id", F.lit(-1).alias("task"), F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = head.unionByName(placed.select("conv_id", "task", "at", "role", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "task", "at")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str, str]]:
    """A stream's repaired turns (conv_id, edit, role, text); a conversation begins with one whose edit is None."""
    conv, audit, at, state = None, "", 0, 0
    for batch in batches:
        for i, task, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "task", "role", "text")), strict=True):
            head = task < 0
            while at < len(audit) and audit[at] == "I":
                role_due, state = DUE[state]
                yield conv, "I", ROLES[role_due], ""
                at += 1
            if head:
                conv, audit, at, state = i, text, 0, 0
                yield conv, None, "", ""
                continue
            edit, at = audit[at], at + 1
            if edit == "K":
                state = NEXT[state][role[0]]
                yield conv, "K", role, text
            elif edit == "R":
                role_due, state = DUE[state]
                yield conv, "R", ROLES[role_due], text
    while at < len(audit):
        role_due, state = DUE[state]
        yield conv, "I", ROLES[role_due], ""
        at += 1


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, 1024)):
        columns = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text) of the repaired conversations; an inserted turn has an empty text.

    ``rows`` are (conv_id, turn, role, text, copy); NULL roles and texts must have been replaced. Turns stand in order
    of (turn, role, text, copy), NULLs first; those of a NULL conv_id are one conversation. Repeated rows are turns
    that were seen before. Conversations without turns, or all of whose turns are deleted, give no rows.
    """
    placed = placed_turns(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered() -> Iterator[tuple]:
            position = 0
            for conv, edit, role, text in _edited(batches):
                if edit is None:
                    position = 0
                    continue
                yield conv, position, edit, role, text
                position += 1

        yield from _batches(numbered(), {"conv_id": pa.int64(), "position": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()})

    return _stream(placed, audits(placed)).mapInArrow(write, "conv_id bigint, position bigint, edit string, role string, text string")


def digests(placed: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over ``role:text`` lines. A hash goes over its conversation in order, so one task
    reads all turns of one, a batch at a time and none kept."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            conv, run, line = None, None, ""
            for i, edit, role, text in _edited(batches):
                if edit is None:
                    if run is not None:
                        yield conv, run.hexdigest()
                    conv, run, line = i, hashlib.sha256(), ""
                else:
                    run.update(f"{line}{role}:{text}".encode())
                    line = "\n"
            if run is not None:
                yield conv, run.hexdigest()

        yield from _batches(hashed(), {"conv_id": pa.int64(), "repaired_sha256": pa.string()})

    return _stream(placed, audit).mapInArrow(write, "conv_id bigint, repaired_sha256 string")


def structure_report(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``ids``: faults of its ``rows`` (see ``repaired_turns``), cheapest edits, repaired hash.

    ``gaps`` counts turn numbers missing between the least and the largest, NULLs aside. A conversation without rows
    has zeros, no edits and the hash of nothing. Empty tables give no rows. Other columns are left out.
    """
    placed = placed_turns(rows)
    audit = audits(placed)
    # two levels: a conversation's turn numbers are told apart before they are counted
    turns = placed.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for side in (turns, audit, digests(placed, audit)):
        out = out.alias("o").join(side.alias("s"), F.col("o.conv_id").eqNullSafe(F.col("s.conv_id")), "left").select(
            "o.*", *[f"s.{c}" for c in side.columns if c != "conv_id"])
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
