"""The pipeline's stages, and what they keep."""

import corpus_pipeline
from tablewell.llm import registry


def test_stages_follow_each_other(spark, docs, rows, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1) for r in rows if r[0] is not None][:30], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{k}")
            now = spark.read.parquet(f"{folder}/{k}")
    packed = corpus_pipeline.run(spark, folder)
    assert packed.count() == out.count() > 0
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_stages_take_an_empty_table(spark, none, tmp_path):
    folder = str(tmp_path)
    none.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_one_query_for_each_operator():
    names = registry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
