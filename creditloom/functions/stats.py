"""Distribution tails as column expressions (series, no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SERIES_TERMS = 2000


def chi2_sf(x: Column, df: Column) -> Column:
    """P(X > x) for a chi-square variable: lower incomplete gamma by its power series."""
    a = df / 2.0
    y = x / 2.0
    # log Gamma(a + 1) for whole and half a, as a sum of logs down to Gamma(1) or Gamma(1/2).
    steps = F.when(a >= 1, F.sequence(F.lit(0), F.floor(a).cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    rest = a - F.floor(a)
    log_gamma = F.aggregate(
        steps,
        F.when(rest > 0, F.lit(0.5723649429247001) + F.log(rest)).otherwise(F.lit(0.0)),
        lambda acc, i: acc + F.log(a - i),
    )
    first = F.exp(-y + a * F.log(y) - log_gamma)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        F.struct(first.alias("term"), first.alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * y / (a + n)).alias("term"),
            (acc["total"] + acc["term"] * y / (a + n)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return (
        F.when(x.isNull() | df.isNull() | (df <= 0), None)
        .when(x <= 0, 1.0)
        .when(y > 700, 0.0)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - series))
    )
