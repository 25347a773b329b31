"""Utility bills: payment discipline, spending stability and payment rhythm.

Payment gaps need the order of payments.  Bills are rolled up per account and
payment *day* first: payments on the same day have a gap of zero, and the lag
runs over distinct days only, so an account with very many bills stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

OPTIONAL = ("bill_amount", "on_time_payment", "delay_days", "missed_payments", "payment_date")


def payment_gaps(bills: DataFrame) -> DataFrame:
    """Per account and payment day: bills paid, days since the previous paid day."""
    days = (
        bills.where(F.col("payment_date").isNotNull())
        .groupBy("account_id", F.to_date("payment_date").alias("payment_date"))
        .agg(F.count(F.lit(1)).alias("n_payments"))
    )
    order = W.partitionBy("account_id").orderBy("payment_date")
    return days.withColumn(
        "gap_days", F.datediff("payment_date", F.lag("payment_date").over(order))
    )


def gap_consistency(bills: DataFrame) -> DataFrame:
    """1 / (1 + CV of the gaps between payments); 0.5 where there is no gap at all."""
    g = F.col("gap_days").cast("double")
    sums = payment_gaps(bills).groupBy("account_id").agg(
        (F.sum("n_payments") - 1).alias("n"),
        F.coalesce(F.sum(g), F.lit(0.0)).alias("s1"),
        F.coalesce(F.sum(g * g), F.lit(0.0)).alias("s2"),
    )
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    sd = F.sqrt(F.try_divide(s2 - F.try_divide(s1 * s1, n), n - 1))
    cv = F.when(s1 == 0, 0.0).otherwise(F.try_divide(sd * n, s1))
    return sums.select(
        "account_id", F.when(n == 0, 0.5).otherwise(1 / (1 + cv)).alias("time_consistency")
    )


def variation(mean: Column, sd: Column) -> Column:
    return F.when(mean == 0, 0.0).otherwise(F.try_divide(sd, mean))


def utility_features(bills: DataFrame) -> DataFrame:
    """Discipline and stability per account.

    A part whose column is absent from the frame is left out of the mean.  A part that
    exists but is undefined (one single bill has no spread, no amount is known) makes the
    stability NULL; an account without any payment date has the rhythm 0.5.
    """
    given = set(bills.columns)
    for name in OPTIONAL:
        if name not in bills.columns:
            bills = bills.withColumn(name, F.lit(None).cast("double"))
    sums = bills.groupBy("account_id").agg(
        F.avg("on_time_payment").alias("on_time"),
        F.avg("delay_days").alias("delay"),
        F.avg("bill_amount").alias("amount_mean"),
        F.stddev_samp("bill_amount").alias("amount_sd"),
        F.avg("missed_payments").alias("missed"),
    )
    both = sums.join(gap_consistency(bills), "account_id", "left")
    spread = 1 / (1 + variation(F.col("amount_mean"), F.col("amount_sd")))
    parts = {
        "bill_amount": spread,
        "missed_payments": 1 - F.col("missed"),
        "payment_date": F.coalesce("time_consistency", F.lit(0.5)),
    }
    present = [value.cast("double") for name, value in parts.items() if name in given]
    mean = sum(present[1:], present[0]) / len(present) if present else F.lit(0.5)
    clip = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return both.select(
        "account_id",
        F.coalesce(F.col("on_time"), clip(1 - F.col("delay") / 30), F.lit(0.5)).alias(
            "payment_discipline_flag"
        ),
        clip(mean).alias("utility_stability"),
    )
