"""Scorecard, applicants and labels as SQL views for the comparison engine."""

from __future__ import annotations

from ..functions import vocab as V
from ..operators.scoring import INF, Scorecard
from ..sources.applicants import fixed_card
from .sqlviews import c, r, view

CARD = fixed_card()


def num(x: float) -> str:
    """A double literal that keeps every digit."""
    return f"CAST('{x!r}' AS DOUBLE)"


def woe_case(model: Scorecard, f: str, missing: str = "neutral") -> str:
    empty = model.missing_woe.get(f, 0.0) if missing == "empirical" else 0.0
    bins = model.bins[f]
    whens = " ".join(f"WHEN {f} < {num(b.hi)} THEN {num(b.woe)}" for b in bins[:-1] if b.hi != INF)
    return f"CASE WHEN {f} IS NULL THEN {num(empty)} {whens} ELSE {num(bins[-1].woe)} END"


def z_of(model: Scorecard = CARD) -> str:
    out = num(model.intercept)
    for f, b in model.betas.items():
        out = f"({out}+{num(b)}*{f}_woe)"
    return out


def clip(x: str, lo: float, hi: float) -> str:
    return f"greatest({num(lo)},least({num(hi)},{x}))"


SIGMOID = "(1/(1+exp(-log_odds)))"
SCORE = f"CAST(floor(greatest(300e0,least(900e0,{num(V.OFFSET)}-{num(V.FACTOR)}*log_odds))) AS INTEGER)"
TIER = "CASE WHEN pd<0.2e0 THEN 'Low Risk' WHEN pd<0.4e0 THEN 'Medium Risk' WHEN pd<0.7e0 THEN 'High Risk' ELSE 'Very High Risk' END"

view("feat", """
SELECT b.account_id, credit_debit_ratio, cashflow_cv, net_to_gross_ratio, utility_stability, min_balance_l3m AS min_balance,
  true AS has_bank, s.account_id IS NOT NULL AS has_salary, u.account_id IS NOT NULL AS has_utility, payment_discipline_flag
FROM bank b LEFT JOIN salary s ON s.account_id=b.account_id LEFT JOIN utility u ON u.account_id=b.account_id""", "bank", "salary", "utility")

view("woe5", "SELECT *, " + ", ".join(f"{woe_case(CARD, f)} AS {f}_woe" for f in V.FEATURES) + " FROM feat", "feat")

view("scored0", f"SELECT *, {z_of()} AS log_odds FROM woe5", "woe5")

view("scored", f"""
SELECT *, {SCORE} AS risk_score, {TIER} AS risk_tier FROM (SELECT *, {clip(SIGMOID, V.PROB_EPS, 1 - V.PROB_EPS)} AS pd FROM scored0)""", "scored0")

view("feat6", "SELECT account_id, has_bank, has_salary, has_utility, " + ", ".join(f"{r(f, 6)} AS {f}" for f in V.FEATURES) + " FROM feat", "feat")

view("train", f"""
SELECT *, {clip(SIGMOID, V.PROB_EPS, 1 - V.PROB_EPS)} AS p,
  CASE WHEN ((account_id*7919+104729)%10007)/10007e0 < 1/(1+exp(2-risk)) THEN 1 ELSE 0 END AS y,
  CASE WHEN CAST('0x'||substr(md5(CAST(account_id AS VARCHAR)),1,8) AS BIGINT)%10<8 THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, {z_of()} AS log_odds, CASE WHEN credit_debit_ratio<1 THEN 1.8e0 ELSE 0e0 END+CASE WHEN cashflow_cv>0.65e0 THEN 2e0 ELSE 0e0 END
  +CASE WHEN net_to_gross_ratio<0.7e0 THEN 1.4e0 ELSE 0e0 END+CASE WHEN utility_stability>0.6e0 THEN 1.2e0 ELSE 0e0 END
  +CASE WHEN min_balance<15000 THEN 1.6e0 ELSE 0e0 END AS risk
  FROM (SELECT *, {", ".join(f"{woe_case(CARD, f)} AS {f}_woe" for f in V.FEATURES)} FROM feat6))""", "feat6")

view("app_months", f"""
SELECT account_id, date_trunc('month',txn_date) AS m, CAST(sum(CASE WHEN txn_type='CR' THEN {c('amount')} ELSE 0 END) AS BIGINT) AS cr,
  CAST(sum(CASE WHEN txn_type='DR' THEN {c('amount')} ELSE 0 END) AS BIGINT) AS dr, count(*) FILTER (WHERE narration='EMI PAYMENT') AS loans
FROM ledger_lines GROUP BY ALL""", "ledger_lines")

view("applicants", f"""
SELECT account_id, {r('sum(cr)::BIGINT/count(*)',0)}/100 AS income, {r('sum(dr)::BIGINT/count(*)',0)}/100 AS expenses,
  CAST(300+floor(greatest(0e0,least(1e0,(any_value(c_acctbal)+1000)/11000))*600) AS BIGINT) AS credit_score, CAST(sum(loans) AS BIGINT) AS existing_loans
FROM app_months JOIN customer ON c_custkey=account_id GROUP BY account_id""", "app_months")

view("fraud_in", f"""
SELECT f.account_id, c_name, loan_count_30d, avg_loan_amount, income, CASE WHEN s_nationkey=c_nationkey THEN 1 ELSE 0 END AS location_match,
  CASE WHEN c_mktsegment='HOUSEHOLD' THEN 0 ELSE 1 END AS employment_stability, CASE WHEN f.account_id%3=0 THEN 1 ELSE 0 END AS label
FROM (SELECT account_id, count(*) FILTER (WHERE day>latest-30) AS loan_count_30d, {r('sum(cents)::BIGINT/count(*)',0)}/100 AS avg_loan_amount,
        max(o_orderkey) FILTER (WHERE day=latest) AS last_order
      FROM (SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS day, o_orderkey, {c('o_totalprice')} AS cents,
              max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS latest FROM orders) GROUP BY account_id) f
JOIN customer ON c_custkey=f.account_id JOIN applicants a ON a.account_id=f.account_id
LEFT JOIN (SELECT l_orderkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey)=1) ON l_orderkey=last_order
LEFT JOIN supplier ON s_suppkey=l_suppkey""", "applicants")

view("fraud_out", """
SELECT *, CASE WHEN (loan_count_30d>3)::INT+(location_match=0)::INT+(avg_loan_amount>income*0.5e0)::INT+(employment_stability=0)::INT>=2 THEN 1 ELSE 0 END AS guess FROM fraud_in""",
     "fraud_in")

view("behave", f"""
SELECT m.account_id, {r('sd/1000',2)} AS variance_income, {r('delay',4)} AS bill_delay_days, CAST(n%5 AS INTEGER) AS job_changes,
  CASE WHEN m.account_id%3=0 THEN 1 ELSE 0 END AS label
FROM (SELECT account_id, stddev_samp(cr) AS sd, count(*) AS n FROM app_months GROUP BY 1) m
LEFT JOIN (SELECT account_id, avg(delay_days) AS delay FROM bills GROUP BY 1) d ON d.account_id=m.account_id""", "app_months", "bills")

view("behave_out", """
SELECT *, CASE WHEN coalesce(variance_income>15000,false)::INT+coalesce(bill_delay_days>10,false)::INT+(job_changes>2)::INT>=2 THEN 1 ELSE 0 END AS guess FROM behave""",
     "behave")

view("ids", """
SELECT 'img_'||c_custkey AS image_name, c_name AS truth, CASE WHEN c_custkey%5=0 THEN replace(c_name,'0','O') ELSE c_name END AS predicted,
  CASE c_custkey%3 WHEN 0 THEN 'clean' WHEN 1 THEN 'noisy' ELSE 'tampered' END AS folder FROM customer""")
