"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, segmentation.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows it gets; all but the last return the
columns of ``docs``. Rows that share an id stay or go together. An empty table passes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import mixing, pieces, pii, similar, suffix
from lodegraph.llm.common import materialize, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return suffix.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of five-word shingles) the document with the smallest id stays."""
    groups = similar.near_duplicates(docs)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay"))
    return docs.join(stay, docs.doc_id.eqNullSafe(stay.stay), "left_semi")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    key, copies, copy = (unused(docs, c) for c in ("taken_id", "copies", "copy"))
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    each = docs.join(taken, docs.doc_id.eqNullSafe(taken[key]))
    return each.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document."""
    return pieces.sample(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("PII", personal_data), ("mixing sources", mixture), ("SentencePiece", segmentation)]

#: SQL has neither the fingerprints' XXH64 nor lattices.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
