"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage is written as Parquet and read again as the next one's documents, so a lost executor or a
stopped run costs one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.llm import decontaminate, lines, packing, quality, simhash
from strandset.llm.common import table
from strandset.operators.lineage import own_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (a score below 0.5) go.

    Null, empty and very long texts are scored like others; repeated rows and null ids are judged row by row;
    other columns stay; an empty table gives an empty one.
    """
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"), 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; n_chars follows the text (null for a null text).

    Every row stays. Rows equal in id and text keep their lines; null ids come first; other columns stay.
    """
    kept = lines.dedup_lines(docs, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: links are all pairs whose 64-bit SimHashes of three-word shingles differ in at most 3 bits.

    The smallest id stays, a null id only where there is no other; repeated rows leave one; null and empty
    texts are one group; rows of one id with unlike texts are judged by themselves.
    """
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a long part of one, go.

    Each row is judged by its own whole text; null and empty texts stay; other columns stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in sequences of 2048 tokens; a null or empty text is one end token; repeated rows are packed each."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier, the near-duplicate and the packing stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what is between them lies in the cluster's shared folder."""
    folder = f"{own_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
