"""File sources and sinks: typed CSV, text lines, JSON records, scorecard artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.routing import suffix_of
from ..operators.scoring import Scorecard
from ..session import shared_dir

# Schemas of the labelled CSV inputs.
CSV_SCHEMAS = {
    "fraud": (
        "pan string, loan_count_30d int, avg_loan_amount double, income double, location_match int, "
        "employment_stability int, label int"
    ),
    "behaviour": (
        "user_id int, loan_description string, monthly_income double, variance_income double, "
        "bill_delay_days int, job_changes int, label int"
    ),
    "loans": "loan_amnt double, annual_inc double, dti double, delinq_2yrs int, loan_status string",
    "ground_truth": (
        "image_name string, doc_type string, name string, pan string, amount string, date string, label string"
    ),
    "predictions": "image_name string, folder string, predicted_pan string",
}


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; every run writes to its own."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.json(path)


def records(df: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON record."""
    return df.select(key, F.to_json(F.struct("*")).alias("record"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as lines with their file name and suffix; undecodable bytes become U+FFFD."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", *[c for c in lines.columns if c != "value"], F.col("_metadata.file_path").alias("path")).withColumn(
        "suffix", suffix_of(F.col("path"))
    )


def save_scorecard(spark: SparkSession, card: Scorecard, folder: str) -> None:
    """Bins, coefficients, intercept and missing WoE as parquet tables."""
    card.bins_table(spark).write.parquet(f"{folder}/bins")
    rows = [("beta", f, b) for f, b in card.betas.items()]
    rows += [("missing_woe", f, w) for f, w in card.missing_woe.items()]
    rows += [("mean_woe", f, w) for f, w in card.mean_woe.items()]
    rows += [("intercept", "", card.intercept)]
    order = [(k, f, float(v), i) for i, (k, f, v) in enumerate(rows)]
    spark.createDataFrame(order, "kind string, feature string, value double, place int").coalesce(1).write.parquet(
        f"{folder}/parameters"
    )


def load_scorecard(spark: SparkSession, folder: str) -> Scorecard:
    """The scorecard back from its tables (a few dozen rows)."""
    from ..operators.scoring import Bin

    bins: dict[str, list[Bin]] = {}
    for r in spark.read.parquet(f"{folder}/bins").orderBy("feature", "bin_id").collect():
        bins.setdefault(r.feature, []).append(Bin(r.lo, r.hi, r.woe))
    kinds: dict[str, dict[str, float]] = {}
    for r in spark.read.parquet(f"{folder}/parameters").orderBy("place").collect():
        kinds.setdefault(r.kind, {})[r.feature] = r.value
    betas = kinds["beta"]
    return Scorecard(
        bins={f: tuple(bins[f]) for f in betas},
        betas=betas,
        intercept=kinds["intercept"][""],
        missing_woe=kinds.get("missing_woe", {}),
        mean_woe=kinds.get("mean_woe", {}),
    )
