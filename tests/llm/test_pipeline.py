import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_chain_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert before >= counts[0] > counts[1] >= counts[2] > before / 2
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert docs.select(lowered).distinct().count() == docs.count()
    docs.unpersist()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "pieces", "decoded"]
    assert out.where("text <> decoded").count() == 0 and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_and_odd_rows(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (2, "a b", "en", None, 3)]):
        docs = spark.createDataFrame(rows, shape)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.count()
