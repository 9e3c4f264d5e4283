"""Preparation of a training corpus in stages, each on what the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again as the next one's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentroll.llm import decontaminate, language_id, packing, shingle_join
from rentroll.session import durable


ROW = "_row_key"
#: Up to so many keys of rows that go, the planner may send them to all tasks; more become a filter of so many bits,
#: whatever their number, and only the rows that it holds are moved.
FEW_KEYS, KEY_BITS = 10_000, 1 << 25
#: Words that a worker remembers while packing and text that it works on at once: little, as workers also hold what
#: earlier stages left.
STORE_BYTES, SLICE_BYTES = 48 << 20, 1 << 20


def row_keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each row: its id where ids are there and unique, else the row's place in a stored copy."""
    told = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if len(set(told)) == 1:
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    return durable(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key is not among the only column of ``gone``, as they came.

    The keys are stored first. Where they are few, no text is moved. Where they are many, rows that a filter of fixed size
    does not hold stay where they lie; the others meet their keys in a join that lets the texts pass, so none are sorted."""
    columns = [c for c in keyed.columns if c != ROW]
    stored = durable(gone.toDF(ROW).distinct(), "gone")
    if stored.count() <= FEW_KEYS:
        return keyed.join(stored, ROW, "left_anti").select(columns)
    bit = F.pmod(F.xxhash64(ROW), F.lit(KEY_BITS))
    word, mask = F.shiftright(bit, 6), F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    bits = stored.select(word.alias("_word"), bit.alias("_bit")).select("_word", mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_held"))
    bits = F.broadcast(durable(bits, "gone-bits"))
    marked = keyed.withColumn("_word", word).withColumn("_bit", bit).join(bits, "_word", "left").withColumn(
        "_maybe", F.coalesce(F.col("_held").bitwiseAND(mask) != 0, F.lit(False)))
    unsure = marked.filter("_maybe").join(stored.hint("shuffle_hash"), ROW, "left_anti")
    return marked.filter("not _maybe").select(columns).union(unsure.select(columns))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose text has no language: NULL, empty or without a letter. Every row is judged by its own
    text, whatever its id. Where no row has a language to learn from, a letter alone decides, so no others go."""
    keyed = row_keyed(docs)
    labelled = keyed.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    trees = language_id.fit(labelled.filter(~language_id.held_out(F.col("id"))))
    texts = keyed.select(F.col(ROW).alias("id"), F.col("text").cast("string").alias("text"))
    if trees.langs:
        gone = language_id.predict(texts, trees).filter(F.col("lang_pred") == language_id.UNKNOWN)
    else:
        gone = texts.filter(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return without(keyed, gone.select("id"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of smallest id, or the first where ids are missing or repeated.
    Rows of one id, repeated rows and rows without an id are rows of their own, so of equal texts one is kept."""
    keyed = row_keyed(docs)
    found = durable(shingle_join.jaccard_components(keyed, id_col=ROW), "groups")
    return without(keyed, found.filter(F.col(ROW) != F.col("component_id")).select(ROW))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes rows that leak an item of the benchmark, and no other row of the same id."""
    keyed = row_keyed(docs)
    found = durable(decontaminate.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW), "leaks")
    return without(keyed, found.select(ROW))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents' token ids in training sequences; NULL ids and repeated rows are packed as they are."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), store_bytes=STORE_BYTES,
                                  slice_bytes=SLICE_BYTES)


STAGES = [("language ID", identified), ("n-gram Jaccard join", deduplicated), ("benchmark decontamination", decontaminated),
          ("packing", packed)]

#: Trees of contexts, latent spaces and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
