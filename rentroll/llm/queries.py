"""The registered queries of this package: every operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentroll.llm import (
    chat, decontaminate, grouping, html_extract, language_id, license_scan, near_dedup, packing, sharding, shingle_join, structure_repair,
    token_count, whitening,
)

SHARDS = 8
TOKEN_LIMIT = 512
COMPONENTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.range_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_licence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_notices(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["edits"] == 0)

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.preference_pairs(chat.paired_turns(table(spark, sf_dir, "conversations")))

    def spans(mask: str):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"], s["end"])), " ")

    return made.select("pair_id", "prompt_turns", "prompt", "chosen_turns", "chosen", spans("chosen_mask").alias("chosen_mask"),
                       "rejected_turns", "rejected", spans("rejected_mask").alias("rejected_mask"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_whole_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.pack_whole(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return structure_repair.structure_report(conversations, structure_repair.damaged(conversations))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), COMPONENTS)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_vectors, op2_benchmark_leaks, op3_shingle_join, op4_main_text, op5_range_shards, op6_language,
              op7_licence_notices, op8_preference_pairs, op9_token_counts, op10_packing, op11_whole_packing,
              op12_structure_repair, op13_whitening)
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
  AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), m AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(m.m, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id""",
    "op3_shingle_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i+4], ' ') ELSE array_to_string(w, ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id""",
    "op8_preference_pairs": r"""
WITH t AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, role, text,
  '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, head || coalesce(text, '') || chr(10) AS piece FROM t),
d AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.k, b.k)) FILTER (WHERE a.k IS NULL OR b.k IS NULL
    OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) AS first_other, count(*) AS longest
  FROM (SELECT * FROM r WHERE side = 'chosen') a FULL JOIN (SELECT * FROM r WHERE side = 'rejected') b ON a.pair_id = b.pair_id AND a.k = b.k
  GROUP BY 1),
p AS (SELECT pair_id, CAST(coalesce(first_other - 1, longest) AS INTEGER) AS prompt_turns FROM d),
e AS (SELECT r.*, p.prompt_turns, sum(length(piece)) OVER (PARTITION BY r.pair_id, side ORDER BY k) AS stop FROM r JOIN p USING (pair_id) WHERE k > prompt_turns),
c AS (SELECT pair_id, side, CAST(count(*) AS INTEGER) AS turns, string_agg(piece, '' ORDER BY k) AS said,
  coalesce(string_agg((stop - length(piece) + length(head)) || '-' || stop, ' ' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS mask
  FROM e GROUP BY pair_id, side),
q AS (SELECT p.pair_id, p.prompt_turns, coalesce(string_agg(r.piece, '' ORDER BY r.k), '') AS prompt
  FROM p LEFT JOIN r ON r.pair_id = p.pair_id AND r.k <= p.prompt_turns
    AND r.side = 'chosen' GROUP BY p.pair_id, p.prompt_turns)
SELECT q.pair_id, q.prompt_turns, q.prompt, coalesce(a.turns, 0) AS chosen_turns, coalesce(a.said, '') AS chosen, coalesce(a.mask, '') AS chosen_mask,
  coalesce(b.turns, 0) AS rejected_turns, coalesce(b.said, '') AS rejected, coalesce(b.mask, '') AS rejected_mask
FROM q LEFT JOIN c a ON a.pair_id = q.pair_id AND a.side = 'chosen' LEFT JOIN c b ON b.pair_id = q.pair_id AND b.side = 'rejected'""",
}
