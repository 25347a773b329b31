"""Applicant-level views: model frame, training labels, rule inputs and the fixed scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import cents, number, rnd, stable_hash
from ..functions.vocab import FEATURES
from ..operators import assembly
from ..operators.scoring import Scorecard, card
from . import views
from .tables import table


def fixed_card() -> Scorecard:
    """The reference scorecard (edges, WoE, coefficients, missing WoE)."""
    return card(
        edges={
            "credit_debit_ratio": [0.6, 1.0, 1.6],
            "cashflow_cv": [0.45, 0.65],
            "net_to_gross_ratio": [0.70, 0.74],
            "utility_stability": [0.55, 0.6],
            "min_balance": [0.0, 15000.0, 60000.0],
        },
        woes={
            "credit_debit_ratio": [-0.9, -0.35, 0.3, 0.85],
            "cashflow_cv": [0.8, 0.35, -0.7],
            "net_to_gross_ratio": [-0.8, -0.1, 0.4],
            "utility_stability": [0.5, 0.1, -0.6],
            "min_balance": [-0.7, -0.3, 0.25, 0.7],
        },
        betas={
            "credit_debit_ratio": -1.1,
            "cashflow_cv": -0.95,
            "net_to_gross_ratio": -0.8,
            "utility_stability": -0.6,
            "min_balance": -0.75,
        },
        intercept=0.25,
        missing_woe={
            "credit_debit_ratio": -0.2,
            "cashflow_cv": -0.1,
            "net_to_gross_ratio": -0.15,
            "utility_stability": -0.05,
            "min_balance": -0.25,
        },
    )


def joined(spark: SparkSession, d: str) -> DataFrame:
    return assembly.join_sources(**views.feature_sources(spark, d))


def features(spark: SparkSession, d: str) -> DataFrame:
    return assembly.model_features(joined(spark, d))


def default_label() -> Column:
    """Label of the training frame: weighted risk signs against a fixed draw per account."""
    sign = lambda cond, w: F.when(cond, w).otherwise(0.0)
    risk = (
        sign(F.col("credit_debit_ratio") < 1.0, 1.8)
        + sign(F.col("cashflow_cv") > 0.65, 2.0)
        + sign(F.col("net_to_gross_ratio") < 0.7, 1.4)
        + sign(F.col("utility_stability") > 0.6, 1.2)
        + sign(F.col("min_balance") < 15000, 1.6)
    )
    draw = ((F.col("account_id") * 7919 + 104729) % 10007) / 10007
    return F.when(draw < 1 / (1 + F.exp(2 - risk)), 1).otherwise(0)


def split_of(key: str) -> Column:
    """train (8 of 10) or test by a hash of the key: stable under repartitioning."""
    return F.when(stable_hash(key) % 10 < 8, "train").otherwise("test")


def train(spark: SparkSession, d: str) -> DataFrame:
    """Labelled features, rounded so that equal values are equal in every engine."""
    six = {f: rnd(F.col(f), 6) for f in FEATURES}
    return features(spark, d).withColumns(six).withColumn("default", default_label()).withColumn("split", split_of("account_id"))


def applicants(spark: SparkSession, d: str) -> DataFrame:
    """Monthly income and expenses, a credit score from the balance, EMI rows as loans."""
    months = (
        views.ledger_lines(spark, d)
        .groupBy("account_id", F.trunc("txn_date", "month").alias("month"))
        .agg(
            F.sum(F.when(F.col("txn_type") == "CR", cents("amount"))).alias("cr"),
            F.sum(F.when(F.col("txn_type") == "DR", cents("amount"))).alias("dr"),
            F.count_if(F.col("narration") == "EMI PAYMENT").alias("loans"),
        )
        .groupBy("account_id")
        .agg(
            F.coalesce(F.sum("cr"), F.lit(0)).alias("cr"),
            F.coalesce(F.sum("dr"), F.lit(0)).alias("dr"),
            F.sum("loans").alias("existing_loans"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("c_acctbal") + 1000) / 11000))
    who = table(spark, d, "customer").select(
        F.col("c_custkey").alias("account_id"), (300 + F.floor(share * 600)).alias("credit_score")
    )
    per_month = lambda c: rnd(F.col(c) / F.col("n"), 0) / 100
    return months.join(who, "account_id").select(
        "account_id", per_month("cr").alias("income"), per_month("dr").alias("expenses"), "credit_score", "existing_loans"
    )


def fraud_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Loans in the last 30 days, average loan, income, location and job flags per account."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice"
    )
    days = o.groupBy("account_id", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("total"), F.max("o_orderkey").alias("last_order")
    )
    latest = days.withColumn("latest", F.max("day").over(W.partitionBy("account_id")))
    per = latest.groupBy("account_id").agg(
        F.sum(F.when(F.col("day") > F.date_sub("latest", 30), F.col("n"))).alias("loan_count_30d"),
        (rnd(F.sum("total") / F.sum("n"), 0) / 100).alias("avg_loan_amount"),
        F.max(F.when(F.col("day") == F.col("latest"), F.col("last_order"))).alias("l_orderkey"),
    )
    first_supplier = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("s_suppkey"))
    )
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    who = table(spark, d, "customer").select(
        F.col("c_custkey").alias("account_id"), "c_nationkey", "c_mktsegment", "c_name"
    )
    income = applicants(spark, d).select("account_id", "income")
    return (
        per.join(first_supplier, "l_orderkey", "left")
        .join(supplier, "s_suppkey", "left")
        .join(who, "account_id")
        .join(income, "account_id")
        .select(
            "account_id", "c_name", "loan_count_30d", "avg_loan_amount", "income",
            F.when(F.col("s_nationkey") == F.col("c_nationkey"), 1).otherwise(0).alias("location_match"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", 0).otherwise(1).alias("employment_stability"),
            F.when(F.col("account_id") % 3 == 0, 1).otherwise(0).alias("label"),
        )
    )


def behaviour_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Spread of monthly credits, mean bill delay and distinct narrations per account."""
    months = (
        views.ledger_lines(spark, d)
        .groupBy("account_id", F.trunc("txn_date", "month").alias("month"))
        .agg(F.sum(F.when(F.col("txn_type") == "CR", cents("amount")).otherwise(0)).alias("cr"))
        .groupBy("account_id")
        .agg(F.stddev_samp("cr").alias("sd"), F.count(F.lit(1)).alias("n"))
    )
    delay = views.bills(spark, d).groupBy("account_id").agg(F.avg("delay_days").alias("delay"))
    return months.join(delay, "account_id", "left").select(
        "account_id",
        rnd(number(F.col("sd")) / 1000, 2).alias("variance_income"),
        rnd(F.col("delay"), 4).alias("bill_delay_days"),
        (F.col("n") % 5).cast("int").alias("job_changes"),
        default_draw().alias("label"),
    )


def default_draw() -> Column:
    return F.when(F.col("account_id") % 3 == 0, 1).otherwise(0)


def identity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """True names and names as read by a scanner that mistakes zeros."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("img_"), key).alias("image_name"),
        F.col("c_name").alias("truth"),
        F.when(key % 5 == 0, F.replace("c_name", F.lit("0"), F.lit("O"))).otherwise(F.col("c_name")).alias("predicted"),
        F.element_at(F.array(*[F.lit(x) for x in ("clean", "noisy", "tampered")]), (key % 3).cast("int") + 1).alias("folder"),
    )


SCENARIOS = (
    {"cashflow_cv": 0.4},
    {"credit_debit_ratio": 1.8, "net_to_gross_ratio": 0.8},
    {"credit_debit_ratio": 0.0, "pf_contribution_flag": True},
)
