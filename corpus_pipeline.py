"""A corpus pipeline: documents that pass one stage are written and read again as the next one's input.

Stages: the quality network (documents it rejects go), exact dedup (one of each group of equal texts stays),
near-duplicates (one of each group stays), benchmark decontamination (documents with a benchmark window go) and
the mix to target weights (documents repeated as often as the mix takes them, with their repeat number).

Defined results: null and empty texts pass or fail the network by its value for them, count as equal to each other, link
with nothing, hold no window and have no words, so the mix leaves them out. Rows alike in doc_id and text count as one. A
row without doc_id keeps its place in every stage but is no near copy of any. An empty table stays empty; without labels
of both classes nothing is rejected. Extra columns are kept, whatever their names, but for `repeat`, which the mix sets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenlake.llm import decontaminate, exactdup, mixing, neardup, quality
from lumenlake.llm.common import delete_folder, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdup.keep_first(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8."""
    return neardup.keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The network's probabilities have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's rows. Each stage's table goes to the shared folder, and is deleted once the next one is written;
    the last stage is read from the one before it, which stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete_folder(spark, f"{folder}/{k - 1}")
    return docs
