"""A training corpus from ``documents``: quality filter, exact and near dedup, mix by source, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import exact_dedup, minhash_dedup, mixing, packing, quality
from trajlake.llm.common import shared_folder


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier predicts to be good.

    Null and empty texts are scored like any other; repeated rows share their fate; columns of ``docs`` stay as they are.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scored = quality.score_quality(docs.select("doc_id", "text", row), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select("_row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts, one of largest id (see ``drop_exact_duplicates`` for odd rows)."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by five-word shingle similarities of 0.8 and more, one of smallest id.

    Rows without doc_id or words stay (see ``drop_near_duplicates``).
    """
    return minhash_dedup.drop_near_duplicates(docs, k=5, threshold=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents, always whole, as often as its target weight says.

    Documents without words are left out (see ``mix``).
    """
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most 1024; one row per piece, with its ids (see ``pack``)."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("best-fit packing", packed_sequences),
]
#: SQL can't express the classifier, the tokenizer or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet to the shared folder and read again.

    An empty table gives an empty result; other columns of ``documents``, whatever their names, go along up to packing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
