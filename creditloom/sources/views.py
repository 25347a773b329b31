"""Credit views over the star-schema tables.

The warehouse holds orders, customers, line items, events and documents; a
scorecard needs ledgers, salary slips, bills, consents, uploads and financial
documents.  Each view below derives one of these from whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import rnd
from ..operators.ledger import bank_features, with_running_balance
from ..operators.income import salary_features
from ..operators.utility import utility_features
from .tables import table

NARRATIONS = {
    "1": "SALARY CREDIT",
    "2": "EMI PAYMENT",
    "3": "NACH DEBIT",
    "4": "ATM CASH",
    "5": "UPI TRANSFER",
}


def ledger_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ledger rows, without a balance."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    credit = (status == "F") | ((status == "P") & (key % 2 == 0))
    first = F.substring("o_orderpriority", 1, 1)
    words = F.create_map(*[F.lit(x) for kv in NARRATIONS.items() for x in kv])
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("account_id"),
        key.alias("txn_id"),
        F.to_date("o_orderdate").alias("txn_date"),
        F.col("o_totalprice").alias("amount"),
        F.when(credit, "CR").otherwise("DR").alias("txn_type"),
        words[first].alias("narration"),
    )


def ledger(spark: SparkSession, d: str) -> DataFrame:
    opening = table(spark, d, "customer").select(
        F.col("c_custkey").alias("account_id"), F.col("c_acctbal").alias("opening_balance")
    )
    return with_running_balance(ledger_lines(spark, d), opening)


def slips(spark: SparkSession, d: str) -> DataFrame:
    """One salary slip per customer; customers whose key is a multiple of 10 draw no salary."""
    per_order = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
            F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("tax"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    per_customer = (
        table(spark, d, "orders")
        .select("o_orderkey", F.col("o_custkey").alias("account_id"), "o_totalprice", "o_orderdate")
        .join(per_order, "o_orderkey", "left")
        .groupBy("account_id")
        .agg(
            F.max("o_totalprice").alias("gross_salary"),
            F.sum("disc").alias("disc"),
            F.sum("tax").alias("tax"),
            F.sum("n").alias("n"),
            F.max("o_orderdate").alias("last_order"),
        )
    )
    segment = table(spark, d, "customer").select(
        F.col("c_custkey").alias("account_id"), "c_mktsegment"
    )
    cut = 3 * (F.col("disc") + F.col("tax")) / (100 * F.col("n"))
    return (
        per_customer.join(segment.where(F.col("account_id") % 10 != 0), "account_id")
        .where(F.col("n") > 0)
        .select(
            "account_id",
            "gross_salary",
            rnd(F.col("gross_salary") * (1 - cut), 2).alias("net_salary"),
            F.when(
                F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
                rnd(F.col("gross_salary") * 0.12, 2),
            ).alias("pf"),
            F.date_format("last_order", "dd/MM/yyyy").alias("pay_period"),
        )
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    return with_k(table(spark, d, "events"))


def with_k(raw: DataFrame) -> DataFrame:
    return raw.select("*", F.from_json("props", "k int")["k"].alias("k"))


def bills(spark: SparkSession, d: str) -> DataFrame:
    """Purchases are paid bills, errors are missed ones."""
    e = events(spark, d).where(F.col("event_type").isin("purchase", "error"))
    paid = F.col("event_type") == "purchase"
    return e.select(
        F.col("user_id").alias("account_id"),
        F.col("event_id").alias("bill_id"),
        F.col("value").alias("bill_amount"),
        F.when(paid, F.to_date("ts")).alias("payment_date"),
        F.when(paid, 0).otherwise(1).alias("missed_payments"),
        (F.col("k") % 60).alias("delay_days"),
    )


def feature_sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "bank": bank_features(ledger(spark, d)),
        "salary": salary_features(slips(spark, d)),
        "utility": utility_features(bills(spark, d)),
    }


def consents(spark: SparkSession, d: str) -> DataFrame:
    return consents_of(events(spark, d))


def uploads(spark: SparkSession, d: str) -> DataFrame:
    return uploads_of(events(spark, d))


def consents_of(events: DataFrame) -> DataFrame:
    """Sign-ups as consent requests; the bits of k are the four consents."""
    bit = lambda i: F.shiftright("k", i).bitwiseAND(F.lit(1)) == 1
    return events.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("session_id"), F.col("user_id").alias("borrower_id"), F.col("ts").alias("created_at"),
        (bit(0) | bit(1)).alias("consent_bank"), bit(1).alias("consent_salary"), bit(2).alias("consent_utility"),
        (bit(3) | bit(0)).alias("consent_dpdpa"),
    )


def uploads_of(events: DataFrame) -> DataFrame:
    """Purchases, clicks and views as document uploads; k decides the document type."""
    kinds = F.array(*[F.lit(x) for x in ("bank", "salary", "utility")])
    return events.where(F.col("event_type").isin("purchase", "click", "view")).select(
        F.col("event_id").alias("upload_id"), F.col("user_id").alias("borrower_id"), F.col("ts").alias("uploaded_at"),
        F.element_at(kinds, F.col("k") % 3 + 1).alias("doc_type"),
    )
