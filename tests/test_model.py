"""Closed-form identities of the scorecard and brute-force checks of the shared machinery."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from creditloom.functions import vocab as V
from creditloom.functions.stats import chi2_sf
from creditloom.operators import binning as B, explain as X, metrics as M, model as L, ordered as O, scoring as S
from creditloom.session import cut_lineage
from creditloom.sources import applicants as P


@pytest.fixture(scope="module")
def train(spark):
    return cut_lineage(P.train(spark, SMALL))


def test_points_add_up_to_the_score(spark, train):
    card = P.fixed_card()
    s = S.score_batch(train, card)
    points = sum((S.feature_points(card, f) for f in card.features), F.lit(0.0)) - F.lit(V.FACTOR * card.intercept)
    raw = F.lit(V.OFFSET) - F.lit(V.FACTOR) * F.col("log_odds")
    assert s.agg(F.max(F.abs(points - raw))).first()[0] < 1e-9
    inside = s.where((raw > 300) & (raw < 900))
    assert inside.where(F.col("risk_score") != F.floor(raw)).count() == 0


def test_riskier_means_lower(spark, train):
    s = S.score_batch(train, P.fixed_card())
    r = s.select(F.corr("pd", "risk_score").alias("a"), ).first()
    assert r.a < -0.9


def test_shap_adds_up_to_log_odds(spark, train):
    from dataclasses import replace

    card = P.fixed_card()
    s = S.score_batch(train, card)
    card = replace(card, mean_woe=X.mean_woe(s, card))
    base = card.intercept + sum(b * card.mean_woe[f] for f, b in card.betas.items())
    total = sum((F.col(f + "_shap") for f in card.features), F.lit(base))
    gap = X.with_shap(s, card).agg(F.max(F.abs(total - F.col("log_odds")))).first()[0]
    assert gap < 1e-9


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1e4, 400), np.full(300, 5.0), rng.uniform(0, 1, 300)])
    df = spark.createDataFrame(pd.DataFrame({"g": np.where(np.arange(1000) % 2, "a", "b"), "v": values}))
    table = O.cumulate(df, "g", "v", {"n": F.count(F.lit(1))})
    probs = [0, 0.05, 0.25, 0.5, 0.9, 1]
    for r in O.quantiles(table, "g", "v", probs).collect():
        mine = values[1::2] if r.g == "a" else values[0::2]
        assert np.allclose(r.edges, np.quantile(mine, probs), rtol=1e-12)


def test_running_totals(spark):
    values = [3.0, -2.0, 3.0, 0.5, -2.0, 1e9, 0.25]
    df = spark.createDataFrame([("all", v) for v in values], "g string, v double")
    got = {r.v: (r.n, r.cum_n, r.total_n) for r in O.cumulate(df, "g", "v", {"n": F.count(F.lit(1))}).collect()}
    assert got == {-2.0: (2, 2, 7), 0.25: (1, 3, 7), 0.5: (1, 4, 7), 3.0: (2, 6, 7), 1e9: (1, 7, 7)}


def test_auc_and_ks_brute_force(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.uniform(0, 1, 200), 1)
    y = (rng.uniform(0, 1, 200) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": "all", "p": p, "y": y}))
    t = M.label_table(df, "y", "p", "g")
    bad, good = p[y == 1], p[y == 0]
    wins = np.mean([(b > g) + 0.5 * (b == g) for b, g in itertools.product(bad, good)])
    assert M.auc(t, "g").first().auc == pytest.approx(wins)
    ks = max(abs((bad >= c).mean() - (good >= c).mean()) for c in np.unique(p)) * 100
    assert M.ks(t, "g", "p").first().ks == pytest.approx(ks, abs=0.0051)


def test_quantile_bins_match_pandas(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.beta(2, 5, 300), 2)
    df = spark.createDataFrame(pd.DataFrame({"g": "all", "p": p, "y": 0}))
    got = {r.p: r.bin for r in M.quantile_bins(M.label_table(df, "y", "p", "g"), "g", "p").collect()}
    codes = pd.qcut(p, 10, labels=False, duplicates="drop")
    assert all(got[v] == c + 1 for v, c in zip(p, codes))


@pytest.mark.parametrize(("x", "df"), [(0.3, 1), (3.84, 1), (9.0, 2), (12.5, 8), (5.0, 7), (60.0, 4), (2000.0, 8)])
def test_chi_square_tail(spark, x, df):
    got = spark.range(1).select(chi2_sf(F.lit(x), F.lit(df)).alias("p")).first().p
    if df % 2 == 0:
        want = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))
    else:
        want = math.erfc(math.sqrt(x / 2))
        for k in range(1, df - 1, 2):
            want += math.exp(-x / 2) * (x / 2) ** (k / 2) / math.gamma(k / 2 + 1)
    assert got == pytest.approx(want, abs=1e-9)


def test_merge_is_the_best_of_all_merges():
    rng = np.random.default_rng(4)
    for _ in range(5):
        n = rng.integers(20, 60, 8)
        bad = rng.binomial(n, rng.uniform(0.1, 0.9, 8))
        pdf = pd.DataFrame({"feature": "f", "prebin": range(8), "lo": np.arange(8.0), "hi": np.arange(1.0, 9.0), "n": n, "bad": bad})
        got = B.merge_prebins(pdf)
        best = 0.0
        tb, tg = bad.sum(), (n - bad).sum()
        for k in range(6):
            for cuts in itertools.combinations(range(1, 8), k):
                parts = np.split(np.arange(8), cuts)
                if any(n[p].sum() < 0.05 * n.sum() for p in parts):
                    continue
                h = [0.5 if bad[p].sum() in (0, n[p].sum()) else 0.0 for p in parts]
                b = [(bad[p].sum() + x) / tb for p, x in zip(parts, h)]
                g = [((n - bad)[p].sum() + x) / tg for p, x in zip(parts, h)]
                w = np.log(np.array(g) / np.array(b))
                if np.all(np.diff(w) >= 0) or np.all(np.diff(w) <= 0):
                    best = max(best, float(np.sum((np.array(g) - np.array(b)) * w)))
        assert got["iv"].sum() == pytest.approx(best)
        assert got["n_event"].sum() == tb and (got["n_event"] + got["n_nonevent"]).min() >= 0.05 * n.sum()


def test_fitted_bins(spark, train):
    bins = cut_lineage(B.fit_bins(train))
    assert all(r.is_monotone for r in B.monotone(bins).collect())
    assert bins.where(F.col("iv") < 0).count() == 0
    assert bins.groupBy("feature").agg(F.sum(F.col("n_event") + F.col("n_nonevent")).alias("n")).where(F.col("n") != train.count()).count() == 0
    again = B.fit_bins(train.repartition(7, F.rand(5)))
    assert sorted(map(tuple, bins.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_missing_feature_is_an_error(spark, train):
    with pytest.raises(ValueError, match="not found"):
        B.fit_bins(train.drop("cashflow_cv"))


def test_logistic_regression_is_stationary(spark, train):
    df = cut_lineage(S.with_woe(train, P.fixed_card()))
    intercept, betas = L.fit(df)
    n = df.agg(F.count_if(F.col("default") == 1).alias("b"), F.count_if(F.col("default") == 0).alias("g")).first()
    total = n.b + n.g
    w = F.when(F.col("default") == 1, total / (2 * n.b)).otherwise(total / (2 * n.g))
    z = sum((F.lit(b) * F.col(f + "_woe") for f, b in betas.items()), F.lit(intercept))
    resid = w * (S.sigmoid(z) - F.col("default"))
    grads = df.agg(F.sum(resid).alias("b0"), *[F.sum(resid * F.col(f + "_woe")).alias(f) for f in betas]).first()
    assert abs(grads["b0"]) / total < 1e-9
    assert all(abs(grads[f] + betas[f]) / total < 1e-9 for f in betas)


def test_logistic_regression_in_numpy(spark):
    """Also where one feature tells the labels apart and no finite unpenalised minimum exists."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, 2)), 1)
    y = (x[:, 0] > 0.3).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, y)], "a_woe double, b_woe double, default int")
    intercept, betas = L.fit(df, features=("a", "b"), c=50.0)
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    full = np.column_stack([np.ones(300), x])
    b = np.array([intercept, betas["a"], betas["b"]])
    error = weight * (1 / (1 + np.exp(-full @ b)) - y)
    assert np.allclose(full.T @ error + np.array([0, 1, 1]) / 50 * b, 0, atol=1e-6) and betas["a"] > 5
    with pytest.raises(ValueError, match="both labels"):
        L.fit(df.where("default = 1"), features=("a", "b"))


def test_newton_works_on_cells(spark, train):
    """The steps read distinct encodings, not applicants."""
    df = S.with_woe(train, P.fixed_card())
    columns = [f + "_woe" for f in L.V.FEATURES]
    cells = L.cells(df, "default", columns).collect()
    assert sum(r.n for r in cells) == df.count() and len(cells) < df.count()


def test_vif_at_least_one(spark, train):
    assert all(r.vif >= 1 for r in L.vif(S.with_woe(train, P.fixed_card())).collect())


def test_whatif_zero_is_a_value_and_null_keeps(spark, train):
    out = S.what_if(train, P.fixed_card(), [{}, {"credit_debit_ratio": 0.0}])
    assert out.where((F.col("scenario_id") == 1) & (F.col("delta") != 0)).count() == 0
    assert out.where((F.col("scenario_id") == 2) & (F.col("delta") > 0)).count() == 0
    assert out.where((F.col("scenario_id") == 2) & (F.col("delta") < 0)).count() > 0
