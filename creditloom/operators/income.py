"""Salary slip ratios: expressions over one row per slip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import ratio, rnd
from ..functions.fields import number_or_zero


def net_to_gross(gross: Column, net: Column) -> Column:
    return ratio(net, gross, 0.0)


def pays_pf(df: DataFrame) -> Column:
    paid = F.lit(False)
    for name in ("pf", "pf_deduction"):
        if name in df.columns:
            paid = paid | (number_or_zero(name) > 0)
    return paid


def salary_features(slips: DataFrame, key: str = "account_id") -> DataFrame:
    gross, net = number_or_zero("gross_salary"), number_or_zero("net_salary")
    return slips.select(
        key,
        net_to_gross(gross, net).alias("net_to_gross_ratio"),
        pays_pf(slips).alias("pf_contribution_flag"),
        F.when(net <= 0, 0.0)
        .otherwise(rnd(F.try_divide(gross, net), 4))
        .alias("income_overstate_ratio"),
        F.when(net > 0, 1).otherwise(0).alias("salary_consistency_score"),
    )
