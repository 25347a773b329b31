"""One account, document source or borrower may hold most rows; results must not change."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from creditloom.operators import consent as C, extract as E, ledger as L, segmented as G, utility as U
from creditloom.sources import documents as D, views
from creditloom.plans.learner_plans import stream_verdicts


def hot_lines(n=3000):
    rng = np.random.default_rng(7)
    account = np.where(rng.uniform(size=n) < 0.6, 1, rng.integers(2, 40, n))
    return pd.DataFrame(
        {
            "account_id": account,
            "txn_id": rng.permutation(n),
            "txn_date": [dt.date(2023, 1, 1) + dt.timedelta(days=int(x)) for x in rng.integers(0, 200, n)],
            "amount": np.round(rng.uniform(1, 1000, n), 2),
            "txn_type": np.where(rng.uniform(size=n) < 0.5, "CR", "DR"),
            "narration": np.where(rng.uniform(size=n) < 0.2, "SALARY CREDIT", "UPI TRANSFER"),
        }
    )


def test_running_balance_of_a_hot_account(spark):
    pdf = hot_lines()
    opening = pd.DataFrame({"account_id": range(1, 40), "opening_balance": 100.0})
    out = L.with_running_balance(spark.createDataFrame(pdf), spark.createDataFrame(opening)).toPandas()
    assert len(out) == len(pdf)
    pdf = pdf.sort_values(["account_id", "txn_date", "txn_id"])
    sign = np.where(pdf["txn_type"] == "CR", 1, -1)
    pdf["want"] = 100.0 + (pdf["amount"] * sign).groupby(pdf["account_id"]).cumsum()
    both = out.merge(pdf[["txn_id", "want"]], on="txn_id")
    assert np.allclose(both["closing_balance"], both["want"], atol=1e-6)


def test_running_balance_of_a_hot_day(spark):
    """One day of one account holds 30 % of all rows and is cut into pieces; each row gets the same balance."""
    pdf = hot_lines()
    pdf.loc[pdf.index[:1000], ["account_id", "txn_date"]] = [1, dt.date(2023, 3, 1)]
    opening = pd.DataFrame({"account_id": range(1, 40), "opening_balance": 100.0})
    lines, opening = spark.createDataFrame(pdf).repartition(5, "txn_id"), spark.createDataFrame(opening)
    sizes = G.with_pieces(lines, ["account_id", "txn_date"], ["txn_id"], 50).groupBy("account_id", "txn_date", G.PIECE).count()
    sizes = sizes.toPandas()
    hot = sizes[(sizes["account_id"] == 1) & (sizes["txn_date"] == dt.date(2023, 3, 1))]
    assert hot["count"].sum() > 900 and len(hot) > 8 and hot["count"].max() < 4 * 50 and hot[G.PIECE].min() == 1
    assert set(sizes.loc[sizes["account_id"] != 1, G.PIECE]) == {0}
    cut = {r.txn_id: r.closing_balance for r in L.with_running_balance(lines, opening, 50).collect()}
    pdf = pdf.sort_values(["account_id", "txn_date", "txn_id"])
    pdf["want"] = 100.0 + (pdf["amount"] * np.where(pdf["txn_type"] == "CR", 1, -1)).groupby(pdf["account_id"]).cumsum()
    assert len(cut) == len(pdf)
    assert np.allclose([cut[t] for t in pdf["txn_id"]], pdf["want"], atol=1e-6)
    whole = {r.txn_id: r.closing_balance for r in L.with_running_balance(lines, opening).collect()}
    assert whole == cut


def test_pieces_of_odd_groups(spark):
    """NULL keys and empty tables stay whole; equal places share a piece; NULL places come first."""
    rows = [(None, i) for i in range(300)] + [(1, 7)] * 300 + [(2, i if i % 10 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, at int")
    got = G.with_pieces(df, ["k"], ["at"], 20).toPandas()
    assert len(got) == len(rows)
    assert set(got.loc[got["k"].isna(), G.PIECE]) == {0}
    assert got.loc[got["k"] == 1, G.PIECE].nunique() == 1
    two = got[got["k"] == 2].sort_values("at", na_position="first")
    assert two[G.PIECE].is_monotonic_increasing and two[G.PIECE].nunique() > 5
    assert G.with_pieces(df.limit(0), ["k"], ["at"], 20).count() == 0


def test_bank_features_of_a_hot_account(spark):
    pdf = hot_lines()
    pdf["closing_balance"] = pdf["amount"] - 500
    df = spark.createDataFrame(pdf)
    got = {r.account_id: r for r in L.bank_features(df).collect()}
    again = {r.account_id: r for r in L.bank_features(df.repartition(9, F.rand(3))).collect()}
    assert got == again
    one = pdf[pdf["account_id"] == 1].assign(month=lambda x: pd.to_datetime(x["txn_date"]).dt.to_period("M"))
    monthly = one.groupby("month")["amount"].sum()
    assert abs(got[1].cashflow_cv - monthly.std() / monthly.mean()) < 1e-4
    cr, dr = (one[one["txn_type"] == t]["amount"].sum() for t in ("CR", "DR"))
    assert abs(got[1].credit_debit_ratio - cr / dr) < 1e-4
    latest = pd.Timestamp(one["txn_date"].max()) - pd.DateOffset(months=3)
    recent = one[pd.to_datetime(one["txn_date"]) >= latest]
    assert got[1].min_balance_l3m == round(recent["closing_balance"].min(), 2)


def test_payment_gaps_with_many_bills_a_day(spark):
    rng = np.random.default_rng(8)
    days = np.sort(rng.integers(0, 50, 400))
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=int(x)) for x in days]
    df = spark.createDataFrame(pd.DataFrame({"account_id": 1, "payment_date": dates}))
    gaps = pd.Series(days).diff().dropna()
    want = 1 / (1 + gaps.std() / gaps.mean())
    assert abs(U.gap_consistency(df).first().time_consistency - want) < 1e-9


def test_single_bill_has_no_stability(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 5.0), (2, 5.0)], "account_id int, bill_amount double")
    got = {r.account_id: (r.payment_discipline_flag, r.utility_stability) for r in U.utility_features(df).collect()}
    assert got == {1: (0.5, None), 2: (0.5, 1.0)}


@pytest.mark.parametrize("span, min_rows", [(20000, G.MIN_ROWS), (20000, 1), (9, 20)])
def test_consent_of_a_busy_borrower(spark, span, min_rows):
    """Also with all rows in two slots, which are cut into pieces."""
    base = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(9)
    consents = pd.DataFrame(
        {
            "session_id": range(200), "borrower_id": 1,
            "created_at": [base + dt.timedelta(minutes=int(m)) for m in rng.integers(0, span, 200)],
            "consent_bank": True, "consent_salary": rng.uniform(size=200) < 0.5, "consent_utility": True,
            "consent_dpdpa": rng.uniform(size=200) < 0.8,
        }
    )
    uploads = pd.DataFrame(
        {
            "upload_id": range(500), "borrower_id": 1,
            "uploaded_at": [base + dt.timedelta(minutes=int(m)) for m in rng.integers(0, span, 500)],
            "doc_type": rng.choice(["bank", "salary", "utility"], 500),
        }
    )
    got = {
        r.upload_id: r.status
        for r in C.match_uploads(spark.createDataFrame(uploads), spark.createDataFrame(consents), min_rows).collect()
    }
    opened = consents[consents["consent_bank"] & consents["consent_dpdpa"]]
    for u in uploads.itertuples():
        fits = opened[(opened["created_at"] <= u.uploaded_at) & (u.uploaded_at <= opened["created_at"] + pd.Timedelta(minutes=60))]
        if fits.empty:
            want = 401
        else:
            s = fits.sort_values(["created_at", "session_id"]).iloc[-1]
            want = 403 if u.doc_type == "salary" and not s["consent_salary"] else 200
        assert got[u.upload_id] == want


def test_stream_agrees_with_batch(spark):
    full = stream_verdicts(spark, SMALL).collect()
    stream = {(r.upload_id, r.session and r.session.session_id, r.status) for r in full}
    batch = C.match_uploads(views.uploads(spark, SMALL), views.consents(spark, SMALL)).collect()
    assert stream == {(r.upload_id, r.session and r.session.session_id, r.status) for r in batch}
    assert len(full) == len(batch)


def test_pages_of_a_busy_account_spread(spark):
    """Above the join that gives a page its number there is an exchange by page, also without a broadcast."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D.statements(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    join = plan.index("SortMergeJoin")
    assert "hashpartitioning(doc_id" in plan[:join]
    assert "SortMergeJoin [account_id" in plan and "salt" in plan[join : join + 120]


def test_statement_pages_hold_every_line_once(spark):
    lines = D.statement_lines(spark, SMALL)
    assert lines.count() == views.ledger_lines(spark, SMALL).count()
    assert E.transactions(D.statements(spark, SMALL)).count() == lines.count()
