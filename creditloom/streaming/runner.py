"""Start a stream, let it process what is there, and hand back its sink."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.files import fresh_dir


@dataclass(frozen=True)
class Drained:
    """A parquet sink and the checkpoint of the stream that fills it."""

    spark: SparkSession
    schema: StructType
    folder: str

    @property
    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/out")


def _run(stream: DataFrame, folder: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain(stream: DataFrame, name: str) -> Drained:
    """Process all available input into a parquet sink."""
    folder = fresh_dir(stream.sparkSession, name)
    _run(stream, folder)
    return Drained(stream.sparkSession, stream.schema, folder)


def drain_again(stream: DataFrame, before: Drained) -> Drained:
    """Go on from the checkpoint of an earlier run with the input that has come since."""
    _run(stream, before.folder)
    return before
