"""Rows leave the pipeline's stages without the others' texts being sorted."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize(("few", "bits"), [(0, 1 << 25), (0, 64), (10, 64)])
def test_rows_that_go_are_told_without_sorting_texts(spark, rows, few, bits, monkeypatch, capsys):
    monkeypatch.setattr(corpus_pipeline, "FEW_KEYS", few, raising=False)
    monkeypatch.setattr(corpus_pipeline, "KEY_BITS", bits, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k" if few else "1k")
    try:
        docs = rows([(i // 2 if i < 20 else None, f"text {i}") for i in range(40)], "doc_id bigint, text string")
        keyed = corpus_pipeline.row_keyed(docs.union(docs.filter("doc_id = 3")))
        gone = keyed.filter("text in ('text 1', 'text 6', 'text 30')").select(corpus_pipeline.ROW)
        kept = corpus_pipeline.without(keyed, gone.union(gone))
        assert kept.columns == ["doc_id", "text"]
        want = sorted([f"text {i}" for i in range(40) if i not in (1, 6, 30)] + ["text 7"])
        assert sorted(r.text for r in kept.collect()) == want
        assert sorted(r.text for r in corpus_pipeline.without(keyed, gone.filter(F.lit(False))).collect()) == sorted(
            r.text for r in keyed.collect())
        capsys.readouterr()
        kept.explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Sort" not in plan and ("BroadcastHashJoin" if few else "ShuffledHashJoin") in plan
    assert not few or "hashpartitioning" not in plan


def test_rows_outside_the_filter_are_not_moved(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "FEW_KEYS", 0, raising=False)
    path = str(tmp_path / "docs")
    spark.range(2000).selectExpr("id as doc_id", "concat('text ', id) as text").repartition(3).write.parquet(path)
    keyed = corpus_pipeline.row_keyed(spark.read.parquet(path))
    kept = corpus_pipeline.without(keyed, keyed.filter("doc_id % 10 = 0").select(corpus_pipeline.ROW))
    stay = [r.doc_id for r in keyed.collect() if r.doc_id % 10]
    assert len(stay) == 1800 and stay != sorted(stay)
    assert [r.doc_id for r in kept.collect()] == stay  # a row that is moved does not keep its place
