"""Written intermediates, worker caches and the crc split shared by the operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import shared_dir


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: read by several jobs, kept when executors are lost."""
    folder = fresh_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def worker_cache(name: str) -> dict:
    """A dictionary that lives in the Python worker across its tasks of one stage; the next stage starts with empty ones."""
    import pyspark
    from pyspark import TaskContext

    task = TaskContext.get()
    stage = task.stageId() if task else None
    kept = pyspark.__dict__.setdefault("_llm_worker_cache", {})
    if kept.get("stage") != stage:
        kept.clear()
        kept["stage"] = stage
    return kept.setdefault(name, {})


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a column as text, modulo n; NULL counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def if_small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Hint a broadcast only for a frame whose counted rows are below a bound; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= bound else df


def drawn(rows: DataFrame, n: int) -> DataFrame:
    """About the first ``n`` rows in the order of the hash ``place``.

    A share of the hash range that holds twice as many comes first, so that every task hands on a few rows only.
    """
    share = min(1.0, 2 * n / max(1, rows.count()))
    return rows.where(F.pmod("place", F.lit(1 << 40)) < share * float(1 << 40)).orderBy("place").limit(n)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Hand rows that carry whole texts or sets to Python in smaller batches than the default, for the jobs run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
