"""Balanced logistic regression on WoE columns and its diagnostics."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions import vocab as V
from ..functions.columns import rnd
from ..functions.stats import chi2_sf
from ..session import cut_lineage

# Functions sent to Python workers travel by value: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RIDGE = 1e-8
STEPS, TOLERANCE = 50, 1e-10


def cells(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Distinct (label, columns) with their number of rows.

    Encoded columns take a few values each, so this table is bounded by the bins and not by the applicants.
    """
    return df.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("double").alias("y"), *columns).agg(F.count(F.lit(1)).alias("n"))


def newton_sums(cells: DataFrame, columns: Sequence[str], beta: Sequence[float], weights: tuple[float, float]) -> np.ndarray:
    """Loss, gradient and upper triangle of the curvature at ``beta`` (intercept first): one aggregate, one row."""
    y, x = F.col("y"), [F.lit(1.0), *[F.col(c) for c in columns]]
    z = sum((F.lit(float(b)) * v for b, v in zip(beta[1:], x[1:])), F.lit(float(beta[0])))
    at = cells.select("y", *columns, z.alias("z"), (F.when(y == 1, weights[1]).otherwise(weights[0]) * F.col("n")).alias("w"))
    at = at.withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    w, p, z = F.col("w"), F.col("p"), F.col("z")
    loss = w * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z)
    first = [w * (p - y) * v for v in x]
    second = [w * p * (1 - p) * a * b for a, b in combinations_with_replacement(x, 2)]
    return np.array([float(v or 0) for v in at.agg(*[F.sum(c) for c in (loss, *first, *second)]).first()])


def fit(df: DataFrame, label: str = "default", features: Sequence[str] = V.FEATURES, c: float = 1.0, suffix: str = "_woe"):
    """(intercept, betas): L2 with strength 1/C on the sum of losses, classes weighted to equal totals.

    Applicants are folded to their distinct encodings once.  Newton steps on that table then find the minimum, each from one
    aggregate and one small linear system; a step that does not lower the loss is halved.
    """
    columns = [f + suffix for f in features]
    table = cut_lineage(cells(df, label, columns))
    count = {r.y: r.n for r in table.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if set(count) != {0.0, 1.0}:
        raise ValueError("both labels are needed")
    total = count[0.0] + count[1.0]
    weights = (total / (2 * count[0.0]), total / (2 * count[1.0]))
    size = len(columns) + 1
    ridge = np.array([0.0] + [1.0 / c] * len(columns))
    beta, step, best = np.zeros(size), np.zeros(size), np.inf
    for _ in range(STEPS):
        sums = newton_sums(table, columns, beta, weights)
        loss = sums[0] + 0.5 * (ridge * beta**2).sum()
        if loss > best + 1e-9 * abs(best):
            step = step / 2
            beta = beta - step
            continue
        curvature = np.zeros((size, size))
        curvature[np.triu_indices(size)] = sums[1 + size :]
        curvature = curvature + np.triu(curvature, 1).T + np.diag(ridge)
        best, step = loss, -np.linalg.solve(curvature, sums[1 : 1 + size] + ridge * beta)
        beta = beta + step
        if np.abs(step).max() < TOLERANCE:
            break
    return float(beta[0]), dict(zip(features, map(float, beta[1:])))


def coefficient_rows(spark, intercept: float, betas: dict[str, float]) -> DataFrame:
    rows = spark.createDataFrame([("(intercept)", intercept), *betas.items()], "feature string, beta double")
    return rows.withColumn("beta", rnd(F.col("beta"), 6))


def gram(df: DataFrame, p: str, features: Sequence[str] = V.FEATURES, suffix: str = "_woe") -> DataFrame:
    """Upper triangle of X'WX with W = p(1-p): one aggregate, one row."""
    w = F.col(p) * (1 - F.col(p))
    sums = [
        F.sum(w * F.col(a + suffix) * F.col(b + suffix)).alias(f"{a}|{b}")
        for a, b in combinations_with_replacement(features, 2)
    ]
    return df.agg(*sums)


def _square(row: pd.Series, features: Sequence[str]) -> np.ndarray:
    m = np.zeros((len(features), len(features)))
    for i, a in enumerate(features):
        for j, b in enumerate(features[i:], i):
            m[i, j] = m[j, i] = row[f"{a}|{b}"]
    return m


def _diagonal_of_inverse(features: Sequence[str], ridge: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                m = _square(row, features) + np.eye(len(features)) * ridge
                yield pd.DataFrame({"feature": list(features), "inverse": np.diag(np.linalg.pinv(m))})

    return run


def wald(df: DataFrame, betas: dict[str, float], p: str) -> DataFrame:
    """Standard error, Wald chi-square and p-value per coefficient, most significant first."""
    features = tuple(betas)
    inverse = gram(df, p, features).mapInPandas(_diagonal_of_inverse(features, RIDGE), "feature string, inverse double")
    beta = F.create_map(*[F.lit(x) for kv in betas.items() for x in kv])[F.col("feature")]
    t = inverse.select("feature", beta.alias("coefficient"), F.sqrt("inverse").alias("std_error"))
    t = t.withColumn("wald_stat", (F.col("coefficient") / (F.col("std_error") + RIDGE)) ** 2)
    t = t.withColumn("p_value", chi2_sf(F.col("wald_stat"), F.lit(1)))
    return t.withColumn("significant", F.col("p_value") < 0.05).orderBy("p_value", "feature")


def vif(df: DataFrame, features: Sequence[str] = V.FEATURES, suffix: str = "_woe") -> DataFrame:
    """Variance inflation from the correlation matrix, which is one aggregate."""
    corr = df.agg(
        *[
            (F.lit(1.0) if a == b else F.corr(a + suffix, b + suffix)).alias(f"{a}|{b}")
            for a, b in combinations_with_replacement(features, 2)
        ]
    )
    inverse = corr.mapInPandas(_diagonal_of_inverse(tuple(features), 0.0), "feature string, inverse double")
    v = 1 / (1 / F.col("inverse") + 1e-10)
    return inverse.select(
        "feature", rnd(v, 4).alias("vif"), F.when(v < 10, "OK").otherwise("HIGH").alias("status")
    )


def calibrated_intercept(intercept: float, default_rate: float) -> float:
    """Intercept shifted from the balanced 50 % prior to the observed default rate."""
    return intercept + float(np.log(default_rate / (1 - default_rate)))
