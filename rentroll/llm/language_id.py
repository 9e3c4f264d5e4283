"""Language identification by prediction by partial matching.

Each language gets a tree of byte contexts of up to three bytes. A byte seen in its context costs
-log2(count / (n + d)) bits, n being the context's total and d its distinct bytes; an unseen one costs the
escape -log2(d / (n + d)) and is coded in the next shorter context, at last as one of 256 equal bytes. The
statistics are frozen, so the cost of a byte depends on it and the three before it alone and is kept in tables.
The language of the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentroll.llm.words import LOWER, slices

SAMPLE_ROWS = 400  # labelled rows of each language that the trees are grown from (whole texts)
ORDER = 3
UNKNOWN = "und"


@dataclass
class Trees:
    """Code lengths in bits: ``short`` by the last three symbols; ``grams`` and ``long`` for seen runs of four."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol, 0 for bytes that no sample holds
    m: int
    short: np.ndarray  # (m^3, langs): cost of the third symbol after the first two
    escape: np.ndarray  # (m^3, langs): cost of leaving a context of three
    grams: np.ndarray  # sorted codes of runs of four seen in any language
    long: np.ndarray  # (grams, langs)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every row in every language. A row's first bytes are coded as if blanks came before."""
        rows, width = len(offsets) - 1, len(self.langs)
        out = np.zeros((rows, width))
        if not len(data):
            return out
        blank = int(self.symbol[32])
        lengths = np.diff(offsets)
        s = np.full(len(data) + 3 * rows, blank, np.int64)
        shift = 3 * np.arange(1, rows + 1)
        s[np.arange(len(data)) + np.repeat(shift, lengths)] = self.symbol[LOWER[data]]
        code3 = (s[:-2] * self.m + s[1:-1]) * self.m + s[2:]
        code4 = code3[:-1] * self.m + s[3:]
        at = np.searchsorted(self.grams, code4)
        at[at == len(self.grams)] = 0
        seen = self.grams[at] == code4
        cost = self.short[code3[1:]] + self.escape[code3[:-1]]
        cost[seen] = self.long[at[seen]]
        # the byte at position p of the padded slice has its cost at p - 3; the padding itself costs nothing
        total = np.zeros((len(cost) + 1, width))
        np.cumsum(cost, axis=0, out=total[1:])
        first = offsets[:-1] + 3 * np.arange(rows)
        return total[first + lengths] - total[first]


def grow(counts: list[tuple[str, int, int]]) -> Trees:
    """Trees from (lang, four bytes as one number, count) rows."""
    langs = sorted({c[0] for c in counts})
    at = np.array([langs.index(c[0]) for c in counts], np.int64)
    raw = np.array([c[1] for c in counts], np.int64)
    n = np.array([c[2] for c in counts], np.float64)
    parts = [(raw >> (8 * k)) & 255 for k in (3, 2, 1, 0)]
    symbol = np.zeros(256, np.int64)
    known = np.unique(np.concatenate([*parts, [32]])) if len(counts) else np.array([32])
    symbol[known] = np.arange(1, len(known) + 1)
    m, width = len(known) + 1, len(langs)
    a, b, c, d = (symbol[p] for p in parts)

    def table(code: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(code * width + at, n, size * width).reshape(size, width)

    def level(counted: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost of each symbol in each context, escape of each context); counted: (contexts, m, langs)."""
        total, distinct = counted.sum(1, keepdims=True), (counted > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            cost = np.where(counted > 0, -np.log2(counted / (total + distinct)), leave + lower)
        return cost, leave[:, 0]

    one, _ = level(table(d, m)[None], np.full((1, m, width), 8.0))
    two, _ = level(table(c * m + d, m * m).reshape(m, m, width), one)
    three, _ = level(table((b * m + c) * m + d, m**3).reshape(m * m, m, width), np.tile(two, (m, 1, 1)))
    grams, where = np.unique(((a * m + b) * m + c) * m + d, return_inverse=True)
    counted = np.bincount(where * width + at, n, len(grams) * width).reshape(len(grams), width)
    context = grams // m
    total = np.zeros((m**3, width))
    distinct = np.zeros((m**3, width))
    np.add.at(total, context, counted)
    np.add.at(distinct, context, counted > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
        short = three.reshape(m**3, width)
        unseen = escape[context] + short[grams % m**3]
        long = np.where(counted > 0, -np.log2(counted / (total + distinct)[context]), unseen)
    if not len(grams):
        grams, long = np.array([-1]), np.zeros((1, width))
    return Trees(langs, symbol, m, short.astype(np.float32), escape.astype(np.float32), grams, long.astype(np.float32))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees grown from (id, text, lang) rows: ``sample_rows`` whole texts of each language, those of smallest
    id hash. Rows without text or language teach nothing. Runs jobs; only counts reach the driver, whose number
    the sample bounds."""
    usable = labelled.filter("text is not null and lang is not null")
    keys = usable.select("id", "lang", F.xxhash64("id").alias("_h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "id"))
    chosen = keys.withColumn("_n", place).filter(F.col("_n") <= sample_rows).select("id", "lang").distinct()
    sample = usable.join(F.broadcast(chosen), ["id", "lang"])  # at most sample_rows ids of each language

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for low, high, data, offsets in slices(batch.column(0)):
                for i in range(low, high):
                    row = LOWER[data[offsets[i - low] : offsets[i - low + 1]]].astype(np.int64)
                    row = np.concatenate(([32, 32, 32], row))
                    code, n = np.unique((row[:-3] << 24) | (row[1:-2] << 16) | (row[2:-1] << 8) | row[3:], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([langs[i]] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(grams, "lang string, gram bigint, n bigint")
    return grow([tuple(r) for r in counted.groupBy("lang", "gram").agg(F.sum("n")).collect()])


def predict(rows: DataFrame, trees: Trees) -> DataFrame:
    """(id, text, ...) rows as (id, lang_pred, score).

    score: the winner's share of the probability, 2^-bits, over all languages; ties go to the first name. A text
    that is NULL, empty or without a letter is ``und`` with score 0, as is every text where nothing was learned.
    Whole texts are scored; repeated rows stay.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(trees)  # sized by the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            lettered = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model.langs:
                for low, high, data, offsets in slices(batch.column(1)):
                    bits = model.bits(data, offsets)
                    best = bits.argmin(1)
                    share = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    ok = lettered[low:high]
                    pred[low:high] = np.where(ok, np.array(model.langs, object)[best], UNKNOWN)
                    score[low:high] = np.where(ok, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    texted = rows.select(F.col("id").cast("long"), F.col("text"), F.col("text").rlike(r"\p{L}").alias("lettered"))
    return texted.mapInArrow(run, "id bigint, lang_pred string, score double")


def held_out(id_col: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents (doc_id, text, lang) as (doc_id, held_out, lang_pred, score); learns from the other folds only."""
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"),
                            F.col("lang").cast("string").alias("lang"))
    trees = fit(rows.filter(~held_out(F.col("id"))), sample_rows)
    found = predict(rows, trees)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
