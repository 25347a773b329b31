"""Queries over ledgers, slips and bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..functions import fields
from ..operators import ledger as L, utility as U
from ..operators.income import salary_features
from ..sources import views
from .registry import query
from .sqlviews import r, using


def _bank(spark, d):
    return L.bank_features(views.ledger(spark, d))


BANK_COLUMNS = {
    "agg_mean_monthly_credit": "mean_monthly_credit",
    "agg_cashflow_cv": "cashflow_cv",
    "agg_min_balance_l3m": "min_balance_l3m",
    "agg_credit_debit_ratio": "credit_debit_ratio",
    "agg_salary_regularity": "salary_regularity_flag",
    "agg_emi_flag": "emi_detection_flag",
    "agg_income_overstate": "income_overstate_ratio",
}
for _name, _column in BANK_COLUMNS.items():

    @query(_name, using("bank", sql=f"SELECT account_id, {_column} FROM bank"))
    def _one(spark, d, column=_column):
        return _bank(spark, d).select("account_id", column)


@query("agg_bank_features", using("bank", sql="SELECT * FROM bank"))
def agg_bank_features(spark, d):
    return _bank(spark, d)


def _salary(spark, d):
    return salary_features(views.slips(spark, d)).withColumn(
        "net_to_gross_ratio", rnd(F.col("net_to_gross_ratio"), 6)
    )


SALARY_SQL = f"""SELECT account_id, {r('net_to_gross_ratio',6)} AS net_to_gross_ratio, pf_contribution_flag,
 income_overstate_ratio, salary_consistency_score FROM salary"""
for _name, _column in {
    "sal_net_gross": "net_to_gross_ratio",
    "sal_pf_flag": "pf_contribution_flag",
    "sal_overstate": "income_overstate_ratio",
    "sal_consistency": "salary_consistency_score",
}.items():

    @query(_name, using("salary", sql=f"SELECT account_id, {_column} FROM ({SALARY_SQL})"))
    def _one_salary(spark, d, column=_column):
        return _salary(spark, d).select("account_id", column)


@query("sal_features", using("salary", sql=SALARY_SQL))
def sal_features(spark, d):
    return _salary(spark, d)


def _utility(spark, d):
    u = U.utility_features(views.bills(spark, d))
    return u.select(
        "account_id",
        rnd(F.col("payment_discipline_flag"), 6).alias("payment_discipline_flag"),
        rnd(F.col("utility_stability"), 6).alias("utility_stability"),
    )


UTILITY_SQL = f"""SELECT account_id, {r('payment_discipline_flag',6)} AS payment_discipline_flag,
 {r('utility_stability',6)} AS utility_stability FROM utility"""


@query("utl_features", using("utility", sql=UTILITY_SQL))
def utl_features(spark, d):
    return _utility(spark, d)


@query("utl_discipline", using("utility", sql=f"SELECT account_id, payment_discipline_flag FROM ({UTILITY_SQL})"))
def utl_discipline(spark, d):
    return _utility(spark, d).select("account_id", "payment_discipline_flag")


@query("utl_stability", using("utility", sql=f"SELECT account_id, utility_stability FROM ({UTILITY_SQL})"))
def utl_stability(spark, d):
    return _utility(spark, d).select("account_id", "utility_stability")


@query("utl_cv", using("bills", sql=f"""
SELECT account_id, {r('CASE WHEN avg(bill_amount)=0 THEN 0e0 ELSE stddev_samp(bill_amount)/avg(bill_amount) END',6)} AS cv
FROM bills GROUP BY account_id"""))
def utl_cv(spark, d):
    return (
        views.bills(spark, d)
        .groupBy("account_id")
        .agg(F.avg("bill_amount").alias("m"), F.stddev_samp("bill_amount").alias("s"))
        .select("account_id", rnd(U.variation(F.col("m"), F.col("s")), 6).alias("cv"))
    )


@query("utl_gap_consistency", using("gap_stats", sql=f"SELECT account_id, {r('time_consistency',6)} AS time_consistency FROM gap_stats"))
def utl_gap_consistency(spark, d):
    g = U.gap_consistency(views.bills(spark, d))
    return g.select("account_id", rnd(F.col("time_consistency"), 6).alias("time_consistency"))


@query("win_gap", using("bills", sql="""
SELECT account_id, strftime(payment_date,'%Y-%m-%d') AS payment_date, n_payments,
  CAST(date_diff('day', lag(payment_date) OVER (PARTITION BY account_id ORDER BY payment_date), payment_date) AS DOUBLE) AS gap_days
FROM (SELECT account_id, payment_date, count(*) AS n_payments FROM bills WHERE payment_date IS NOT NULL GROUP BY 1,2)"""))
def win_gap(spark, d):
    return U.payment_gaps(views.bills(spark, d)).select(
        "account_id", F.date_format("payment_date", "yyyy-MM-dd").alias("payment_date"), "n_payments",
        F.col("gap_days").cast("double").alias("gap_days"),
    )


@query("win_max_date", using("ledger_lines", sql="""
SELECT account_id, strftime(txn_date,'%Y-%m-%d') AS txn_date, n, strftime(max(txn_date) OVER (PARTITION BY account_id),'%Y-%m-%d') AS latest
FROM (SELECT account_id, txn_date, count(*) AS n FROM ledger_lines GROUP BY 1,2)"""))
def win_max_date(spark, d):
    days = views.ledger_lines(spark, d).groupBy("account_id", "txn_date").agg(F.count(F.lit(1)).alias("n"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return L.with_latest_date(days).select("account_id", day("txn_date"), "n", day("latest"))


@query("prj_coerce_ledger", using("ledger", sql="""
SELECT txn_id, account_id, strftime(txn_date,'%Y-%m-%d') AS txn_date, amount, upper(trim(txn_type)) AS txn_type,
  lower(narration) AS narration, closing_balance, strftime(date_trunc('month',txn_date),'%Y-%m') AS month FROM ledger"""))
def prj_coerce_ledger(spark, d):
    raw = views.ledger(spark, d).select(
        F.col("account_id").alias("ACCOUNT_ID"),
        F.col("txn_id"),
        F.date_format("txn_date", "dd/MM/yyyy").alias("Txn_Date"),
        F.col("amount").cast("string").alias("Amount"),
        F.concat(F.lit(" "), F.lower("txn_type"), F.lit(" ")).alias("Txn_Type"),
        "narration",
        F.col("closing_balance").cast("string").alias("Closing_Balance"),
    )
    typed = L.coerce_ledger(raw)
    return typed.select(
        "account_id", "txn_id", F.date_format("txn_date", "yyyy-MM-dd").alias("txn_date"),
        "amount", "txn_type", "narration", "closing_balance",
        F.date_format("month", "yyyy-MM").alias("month"),
    )


@query("flt_nonempty", using("bank", sql="""
SELECT c_custkey AS account_id, b.account_id IS NOT NULL AS has_ledger FROM customer LEFT JOIN bank b ON b.account_id=c_custkey"""))
def flt_nonempty(spark, d):
    accounts = views.table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"))
    held = views.ledger_lines(spark, d).select("account_id").distinct().withColumn("has_ledger", F.lit(True))
    return accounts.join(held, "account_id", "left").select(
        "account_id", F.coalesce("has_ledger", F.lit(False)).alias("has_ledger")
    )


@query("kw_narration", using("ledger_lines", sql="""
SELECT narration, txn_type, regexp_matches(lower(narration),'salary|sal|payroll|wages') AS is_salary,
  regexp_matches(lower(narration),'emi|loan|finance|home credit|bajaj|hdfc ergo|axis finance|ecs|nach') AS is_emi, count(*) AS n
FROM ledger_lines GROUP BY ALL"""))
def kw_narration(spark, d):
    low = F.lower("narration")
    return (
        views.ledger_lines(spark, d)
        .groupBy("narration", "txn_type", L.is_salary(low).alias("is_salary"), L.is_emi(low).alias("is_emi"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("num_safe", using("slips", sql="""
SELECT account_id, coalesce(pf,0e0) AS pf_or_zero, gross_salary AS gross_or_zero FROM slips"""))
def num_safe(spark, d):
    return views.slips(spark, d).select(
        "account_id",
        fields.number_or_zero(F.col("pf").cast("string")).alias("pf_or_zero"),
        fields.number_or_zero("gross_salary").alias("gross_or_zero"),
    )
