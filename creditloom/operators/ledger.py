"""Bank ledger: coercion, running balance and the seven bank features.

A single account may hold a large share of all rows, so nothing here puts the
raw rows of one account into one task.  Rows are first rolled up per account and
*day* (partial aggregation, spread over all tasks); whatever works per account
afterwards sees at most one row per calendar day (the running balance: and per piece of a very large day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import cents, number, one_of_regex, ratio, rnd
from ..functions.fields import parse_date
from ..functions.vocab import EMI_KEYWORDS, SALARY_KEYWORDS
from . import segmented as G

MONEY = 100.0


def is_salary(narration: Column) -> Column:
    return F.coalesce(narration.rlike(one_of_regex(SALARY_KEYWORDS)), F.lit(False))


def is_emi(narration: Column) -> Column:
    return F.coalesce(narration.rlike(one_of_regex(EMI_KEYWORDS)), F.lit(False))


def coerce_ledger(raw: DataFrame) -> DataFrame:
    """Typed ledger rows: day-first dates, numbers or NULL, tidy type and narration, month."""
    df = raw.toDF(*[c.lower() for c in raw.columns])
    date = F.col("txn_date")
    if df.schema["txn_date"].dataType.typeName() == "string":
        date = parse_date(date)
    return df.select(
        *[c for c in df.columns if c not in _TYPED],
        date.cast("date").alias("txn_date"),
        number("amount").alias("amount"),
        F.upper(F.trim("txn_type")).alias("txn_type"),
        F.lower(F.coalesce("narration", F.lit(""))).alias("narration"),
        number("closing_balance").alias("closing_balance"),
        F.trunc(date, "month").alias("month"),
    )


_TYPED = {"txn_date", "amount", "txn_type", "narration", "closing_balance"}


def with_running_balance(lines: DataFrame, opening: DataFrame, min_rows: int = G.MIN_ROWS) -> DataFrame:
    """closing_balance = opening + signed amounts up to and including each row.

    Prefix sums in three steps: totals per account, day and piece of a day give each piece its starting balance, then a
    window inside the piece finishes the sum.  Only a day with more than its share of all rows has several pieces.
    """
    signed = F.when(F.col("txn_type") == "CR", cents("amount")).otherwise(-cents("amount"))
    lines = G.with_pieces(lines.withColumn("signed", signed), ["account_id", "txn_date"], ["txn_id"], min_rows)
    piece = ["account_id", "txn_date", G.PIECE]
    totals = lines.groupBy(*piece).agg(F.sum("signed").alias("total"))
    before = W.partitionBy("account_id").orderBy("txn_date", G.PIECE).rowsBetween(
        W.unboundedPreceding, -1
    )
    starts = (
        totals.withColumn("moved", F.coalesce(F.sum("total").over(before), F.lit(0)))
        .join(opening, "account_id")
        .select(*piece, (cents("opening_balance") + F.col("moved")).alias("start"))
    )
    inside = W.partitionBy(*piece).orderBy("txn_id").rowsBetween(
        W.unboundedPreceding, 0
    )
    return (
        lines.join(starts, piece)
        .withColumn(
            "closing_balance", (F.col("start") + F.sum("signed").over(inside)) / MONEY
        )
        .drop("signed", "start", G.PIECE)
    )


def daily_rollup(ledger: DataFrame) -> DataFrame:
    """One row per account and day with every partial the bank features need."""
    credit, debit = F.col("txn_type") == "CR", F.col("txn_type") == "DR"
    amount = cents("amount")
    salary = is_salary(F.col("narration"))
    return ledger.groupBy("account_id", "txn_date").agg(
        F.sum(amount).alias("flow"),
        F.sum(F.when(credit, amount)).alias("credit"),
        F.count_if(credit).alias("n_credit"),
        F.sum(F.when(debit, amount)).alias("debit"),
        F.sum(F.when(credit & salary, amount)).alias("salary_credit"),
        F.count_if(salary).alias("n_salary"),
        F.count_if(is_emi(F.col("narration"))).alias("n_emi"),
        F.min("closing_balance").alias("low"),
    )


def merged_days(partials: DataFrame, *keep: str) -> DataFrame:
    """Partials of the same account and day (from several batches) as one row; ``keep`` names columns the account decides."""
    sums = ("flow", "credit", "n_credit", "debit", "salary_credit", "n_salary", "n_emi")
    return partials.groupBy("account_id", "txn_date", *keep).agg(*[F.sum(c).alias(c) for c in sums], F.min("low").alias("low"))


def with_latest_date(days: DataFrame) -> DataFrame:
    return days.withColumn("latest", F.max("txn_date").over(W.partitionBy("account_id")))


def monthly_rollup(days: DataFrame) -> DataFrame:
    recent = F.col("txn_date") >= F.add_months("latest", -3)
    return (
        with_latest_date(days)
        .groupBy("account_id", F.trunc("txn_date", "month").alias("month"))
        .agg(
            F.sum("flow").alias("flow"),
            F.sum("credit").alias("credit"),
            F.sum("n_credit").alias("n_credit"),
            F.sum("debit").alias("debit"),
            F.sum("salary_credit").alias("salary_credit"),
            F.sum("n_salary").alias("n_salary"),
            F.sum("n_emi").alias("n_emi"),
            F.min(F.when(recent, F.col("low"))).alias("low_l3m"),
            F.count_if(recent).alias("recent_days"),
        )
    )


def bank_features(ledger: DataFrame) -> DataFrame:
    """The seven features of every account, from one shared day and month roll-up."""
    return bank_features_of(daily_rollup(coerce_ledger(ledger)))


def bank_features_of(days: DataFrame) -> DataFrame:
    """The seven features from day roll-ups.

    Borrowers without ledger rows get no feature row.  The lowest balance is 0 when no row falls in the last three
    months, and NULL when rows do and none of them states a balance.
    """
    dated = F.col("month").isNotNull()
    paid_in = dated & (F.col("n_credit") > 0)
    zero = F.lit(0)
    total = lambda c: F.coalesce(F.sum(c), zero)
    months = monthly_rollup(days)
    sums = months.groupBy("account_id").agg(
        F.sum(F.when(paid_in, F.coalesce("credit", zero))).alias("dated_credit"),
        F.count_if(paid_in).alias("credit_months"),
        F.count_if(dated).alias("n_months"),
        F.avg(F.when(dated, F.coalesce("flow", zero))).alias("flow_mean"),
        F.stddev_samp(F.when(dated, F.coalesce("flow", zero))).alias("flow_sd"),
        F.min("low_l3m").alias("low"),
        F.sum("recent_days").alias("recent_days"),
        total("credit").alias("credit"),
        total("debit").alias("debit"),
        total("salary_credit").alias("salary_credit"),
        F.count_if(dated & (F.col("n_salary") > 0)).alias("salary_months"),
        F.sum("n_emi").alias("n_emi"),
    )
    few = (F.col("n_months") < 2) | (F.col("flow_mean") == 0)
    return sums.select(
        "account_id",
        F.when(F.col("credit_months") == 0, 0.0)
        .otherwise(rnd(F.try_divide(F.col("dated_credit"), F.col("credit_months")), 0) / MONEY)
        .alias("mean_monthly_credit"),
        F.when(few, 0.0).otherwise(rnd(F.col("flow_sd") / F.nullif("flow_mean", zero), 4)).alias("cashflow_cv"),
        F.when(F.col("recent_days") > 0, rnd(F.col("low"), 2)).otherwise(0.0).alias("min_balance_l3m"),
        rnd(ratio(F.col("credit"), F.col("debit"), 0.0), 4).alias("credit_debit_ratio"),
        (F.col("salary_months") >= 3).alias("salary_regularity_flag"),
        (F.col("n_emi") > 0).alias("emi_detection_flag"),
        rnd(ratio(F.col("credit"), F.col("salary_credit"), 0.0), 4).alias(
            "income_overstate_ratio"
        ),
    )
