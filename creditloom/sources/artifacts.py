"""Versioned artifacts of scorecard runs: the card, its tables by applicant and fitted ML models.

Each publication writes to a folder of its own and ends with one row in the table of commits.  Readers follow that row
only, so a run that dies halfway leaves nothing that anybody reads, and a published version never changes.  There is
one publisher at a time and any number of readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions.vocab import FEATURES
from ..operators import explain as X, scoring as S
from . import files

COMMITS = "version int, folder string, tables array<string>, models array<string>"


@dataclass(frozen=True)
class ArtifactStore:
    """The folder that holds all versions."""

    spark: SparkSession
    folder: str

    def commits(self) -> DataFrame:
        """One row per published version; empty before the first."""
        path = f"{self.folder}/commits"
        self.spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(path)
        return self.spark.read.schema(COMMITS).parquet(path)

    def commit_of(self, version: int | None = None) -> Row:
        """The row of a version, or of the latest one."""
        rows = self.commits()
        found = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version")).first()
        if found is None:
            raise ValueError("nothing is published" if version is None else f"version {version} is not published")
        return found

    def publish(self, card: S.Scorecard, tables: Mapping[str, DataFrame] = {}, models: Mapping[str, Model] = {}) -> int:
        """Write everything, then make it visible under the next version number."""
        version = (self.commits().agg(F.max("version")).first()[0] or 0) + 1
        folder = f"version-{version}-{uuid.uuid4().hex}"
        files.save_scorecard(self.spark, card, f"{self.folder}/{folder}/card")
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{folder}/tables/{name}")
        for name, model in models.items():
            PipelineModel([model]).write().save(f"{self.folder}/{folder}/models/{name}")
        row = [(version, folder, sorted(tables), sorted(models))]
        self.spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return version

    def _path(self, kind: str, name: str, version: int | None) -> str:
        row = self.commit_of(version)
        if name not in row[kind]:
            raise ValueError(f"version {row.version} has no {name} among its {kind}")
        return f"{self.folder}/{row.folder}/{kind}/{name}"

    def card(self, version: int | None = None) -> S.Scorecard:
        return files.load_scorecard(self.spark, f"{self.folder}/{self.commit_of(version).folder}/card")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._path("tables", name, version))

    def model(self, name: str, version: int | None = None) -> PipelineModel:
        return PipelineModel.load(self._path("models", name, version))


def run_tables(applicants: DataFrame, card: S.Scorecard, key: str = "account_id") -> dict[str, DataFrame]:
    """What a scoring run keeps by applicant: encoded features with label and part, PD, score and SHAP values."""
    scored = S.score_batch(applicants, card)
    shap = X.with_shap(scored, card)
    return {
        "woe": scored.select(key, "default", "split", *[f + "_woe" for f in FEATURES]),
        "pd": scored.select(key, "log_odds", "pd"),
        "scores": scored.select(key, "risk_score", "risk_tier"),
        "shap": shap.select(key, *[f + "_shap" for f in FEATURES]),
    }
