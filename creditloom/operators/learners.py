"""Learners around the scorecard: label codes, boosted trees, cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

# Settings of the boosted trees and the folds; BINS is the number of cuts tried for a feature.
TREE_DEPTH, STEP, ROUNDS, BINS, FOLDS, SEED = 4, 0.1, 100, 32, 5, 42


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Categories as their place in alphabetical order."""
    indexer = StringIndexer(inputCol=column, outputCol=column + "_code", stringOrderType="alphabetAsc")
    return indexer.fit(df).transform(df)


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def boosted(label: str, rounds: int = ROUNDS) -> GBTClassifier:
    return GBTClassifier(
        labelCol=label, featuresCol="features", maxDepth=TREE_DEPTH, stepSize=STEP, maxIter=rounds, maxBins=BINS, seed=SEED
    )


def boosted_predictions(train: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    model = boosted(label).fit(_assembled(train, features).select("features", label))
    scored = model.transform(_assembled(test, features))
    return scored.withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def cross_validated_auc(df: DataFrame, features: Sequence[str], label: str, key: str) -> list[tuple[int, float]]:
    """(fold, AUC) of five folds fixed by a hash of the key; the folds are fitted side by side."""
    data = _assembled(df.withColumn("fold", F.pmod(F.xxhash64(F.col(key)), F.lit(FOLDS)).cast("int")), features)
    data = data.select("features", label, "fold")
    judge = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)  # 0: exact

    def one(fold: int) -> tuple[int, float]:
        model = boosted(label).fit(data.where(F.col("fold") != fold))
        return fold, float(judge.evaluate(model.transform(data.where(F.col("fold") == fold))))

    with ThreadPoolExecutor(FOLDS) as pool:
        return list(pool.map(one, range(FOLDS)))
