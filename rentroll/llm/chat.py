"""Preference formatting of chosen and rejected conversations, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written out. A NULL role or text is written as an empty one.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"
TRAINED_ROLE = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def preference_pairs(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(pair_id, side, turn, role, text) rows, side 'chosen' or 'rejected', as one row per pair.

    Turns of a side stand in order of (turn, role, text), NULLs first. The longest run of turns, from the start,
    that both sides share becomes ``prompt``, written once (``prompt_turns`` long). What is left of a side is its
    completion; its mask lists [start, end) code points of the completion that are trained on: the text and the
    closing line break of the trained role's turns. Equal sides are all prompt with two empty completions; a side
    without turns, or that the other one continues, has an empty completion; no turns, no pair. Turns of a NULL
    pair or side belong to no pair. Repeated turns count as turns of their own.

    The prefix is found on (pair, turn) rows: equal turn numbers hold equal lists on both sides up to the first
    that differs. So one aggregation per turn number and one per pair suffice, both hash-distributed on the pair.
    A pair's two conversations are one record and meet in the row that is returned.
    """
    one = F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    at = turns.select("pair_id", "side", F.col("turn").cast("long").alias("turn"), one.alias("said")).filter(
        F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    sides = [
        F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("turn", "said")))).alias(side)
        for side in ("chosen", "rejected")
    ]
    both = at.groupBy("pair_id").agg(*sides)
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a["said"].eqNullSafe(b["said"]), F.lit(False)))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    first_other = F.array_position(F.slice(same, F.lit(1), shorter), False).cast("int")
    prefix = F.when(shorter == 0, 0).when(first_other == 0, shorter).otherwise(first_other - 1)
    cut = both.select("pair_id", "chosen", "rejected", prefix.cast("int").alias("n"))

    def written(run: Column) -> Column:
        return F.array_join(F.transform(run, lambda t: rendered(t["said"]["role"], t["said"]["text"])), "")

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))

    def mask(run: Column) -> Column:
        """Spans from running lengths: each step knows where the turns before it end."""
        start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def step(state: Column, t: Column) -> Column:
            head = F.char_length(F.concat(F.lit(OPEN), F.coalesce(t["said"]["role"], F.lit("")), F.lit(MIDDLE)))
            end = state["end"] + F.char_length(rendered(t["said"]["role"], t["said"]["text"]))
            span = F.struct((state["end"] + head).alias("start"), end.alias("end"))
            trained = F.coalesce(t["said"]["role"] == trained_role, F.lit(False))
            return F.struct(end.alias("end"), F.when(trained, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(run, start, step)["spans"]

    split = cut.select("pair_id", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("shared"),
                       rest("chosen").alias("c"), rest("rejected").alias("r"))
    return split.select(
        "pair_id", F.col("n").alias("prompt_turns"), written(F.col("shared")).alias("prompt"),
        F.size("c").alias("chosen_turns"), written(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"),
        F.size("r").alias("rejected_turns"), written(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"),
    )


def paired_turns(conversations: DataFrame) -> DataFrame:
    """Neighbouring conversations as a pair: an even conv_id is chosen, the odd one after it rejected.

    The table names no pairs, so ids pair conversations, and none falls away: one without a neighbour gives a pair
    with an empty other side. A turn of a NULL conv_id belongs to no pair.
    """
    even = F.pmod(F.col("conv_id"), F.lit(2)) == 0
    return conversations.select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.when(even, "chosen").when(~even, "rejected").alias("side"), "turn", "role", "text")
