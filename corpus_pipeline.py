"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import byte_bpe, line_dedup, ngram_join, quality, source_mix
from skylattice.llm.common import free_name, read_table, staged


#: The first stage's model, by application and folder: what it was learnt from is not what later stages are given.
MODELS: dict[tuple[str, str], quality.Ranking] = {}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranking = quality.learn(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    MODELS[spark.sparkContext.applicationId, sf_dir] = ranking
    return quality.kept(docs, ranking)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduped_documents(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document's quality weight is the classifier's score of it; the model is the first stage's, learnt from all documents' labels. Where
    that stage did not run in this application, the folder's documents teach it."""
    ranking = MODELS.get((spark.sparkContext.applicationId, sf_dir))
    if ranking is None:
        ranking = quality.learn(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    weight = free_name(docs, "quality_weight")
    return source_mix.mixed_documents(quality.with_score(docs, ranking, weight), weight)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("source_mix", source_mix_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The classifier is learnt and the encoder follows a rank file: SQL expresses neither. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
