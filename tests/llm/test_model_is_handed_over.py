"""F1 pipeline: the fourth stage weighs by the first stage's model and needs no documents in the folder."""

import corpus_pipeline


def test_a_folder_with_labels_only(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda folder: sorted(corpus_pipeline.source_mix_stage(spark, docs, folder).select("doc_id").collect())
    corpus_pipeline.MODELS.clear()
    learnt = rows(sf)
    good = corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).count()
    assert 0 < good <= docs.count()
    assert rows(str(tmp_path)) == learnt
