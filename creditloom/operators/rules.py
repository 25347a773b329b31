"""Rule engines: additive risk, reasons, fraud and behaviour rules, fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..functions.columns import compact, rnd

# Thresholds and weights of the rules.
EXPENSE_SHARE = 0.7
STACKING_LIMIT = 3
INCOME_VARIANCE = 15000
BILL_DELAY = 10
JOB_CHANGES = 2
VOTES = 2

c = F.col


def _spends_much() -> Column:
    return c("expenses") > c("income") * EXPENSE_SHARE


def risk_points() -> Column:
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    credit = F.when(c("credit_score") < 600, 0.4).when(c("credit_score") < 700, 0.2).otherwise(0.0)
    loans = F.when(c("existing_loans") > 3, 0.3).when(c("existing_loans") > 1, 0.1).otherwise(0.0)
    return rnd(part(_spends_much(), 0.3) + credit + loans, 2)


def risk_reasons() -> Column:
    return compact(
        F.when(_spends_much(), "High expense to income ratio"),
        F.when(c("credit_score") < 600, "Low credit score").when(c("credit_score") < 700, "Moderate credit score"),
        F.when(c("existing_loans") > 1, "Multiple existing loans"),
    )


def zero_check() -> Column:
    return F.when((c("income") == 0) | (c("credit_score") == 0), "High").otherwise("Low")


def loan_stacking(loans: Column) -> tuple[Column, Column, Column]:
    """(flag, score, reasons); a missing count stands for one loan."""
    stacked = F.coalesce(loans, F.lit(1)) > STACKING_LIMIT
    return (
        stacked,
        F.when(stacked, 0.9).otherwise(0.1),
        compact(F.when(stacked, F.lit("loan_stacking"))),
    )


def votes(tests: Sequence[Column]) -> Column:
    """1 where at least two of the tests hold."""
    n = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    return F.when(n >= VOTES, 1).otherwise(0)


def fraud_votes() -> Column:
    return votes(
        [
            c("loan_count_30d") > STACKING_LIMIT,
            c("location_match") == 0,
            c("avg_loan_amount") > c("income") * 0.5,
            c("employment_stability") == 0,
        ]
    )


def behaviour_votes() -> Column:
    return votes(
        [
            c("variance_income") > INCOME_VARIANCE,
            c("bill_delay_days") > BILL_DELAY,
            c("job_changes") > JOB_CHANGES,
        ]
    )


def either(*flags: Column) -> Column:
    return F.greatest(*flags)
