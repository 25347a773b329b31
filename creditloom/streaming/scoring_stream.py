"""Continuous scoring: uploads as they arrive, joined with the borrower's features, scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.scoring import Scorecard, score_batch


def score_stream(uploads: DataFrame, features: DataFrame, model: Scorecard) -> DataFrame:
    """Scoring is stateless, so the batch function runs unchanged on the stream."""
    arrived = uploads.select("upload_id", F.col("borrower_id").alias("account_id"), "uploaded_at")
    return score_batch(arrived.join(features, "account_id"), model)
