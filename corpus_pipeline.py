"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its result is written as
Parquet and read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditloom.llm import stages
from creditloom.llm.common import fresh_folder, small_batches
from creditloom.llm.queries import QUERIES, SQL
from creditloom.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", stages.known_language),
    ("jaccard_join", stages.one_of_each_group),
    ("decontamination", stages.without_benchmark),
    ("pii", stages.masked),
    ("packing", stages.packed),
]

#: The stages train a network, tokenise and mask by position, which SQL cannot express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            folder = fresh_folder(spark, name)
            stage(spark, docs, sf_dir).write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs


QUERIES = {**QUERIES, "pipeline": run}
