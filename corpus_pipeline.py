"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

quality        texts that the compression classifier rejects (score under 0.5) go
exact_dedup    of equal texts the smallest doc_id stays
near_dedup     of each group linked by Jaccard similarity of 0.8 or more on five-word shingles the smallest doc_id stays
decontaminate  texts with a benchmark passage of ten words go
tokenize       what is left is encoded and decoded: digests of ids and bytes

Every stage works on all that the one before kept. The first four return the columns of
documents unchanged. Rows without doc_id have no identity to report and go at the first
stage, whichever it is. Rows that share a doc_id are judged each by its own text; of
rows that share both, one stays. Null texts count as empty. An empty table passes through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.checkpoints import shared_folder
from weft.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from weft.llm.common import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(spark, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each_group(spark, docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("tokenize", tokenize_stage),
]

#: The first stage learns a classifier and the last merges tokens, neither of which SQL can say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a data directory; stages meet in the shared folder of spark.checkpoint.dir."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
