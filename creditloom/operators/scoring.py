"""Scorecard application: WoE lookup, log-odds, PD, points, tiers, confidence, what-if.

A scorecard is small (a handful of bins and coefficients), so it enters the plan
as literals: scoring is one projection per borrower, without a join or shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vocab as V
from ..functions.columns import ladder, rnd

INF = float("inf")


@dataclass(frozen=True)
class Bin:
    lo: float
    hi: float
    woe: float


@dataclass(frozen=True)
class Scorecard:
    bins: dict[str, tuple[Bin, ...]]
    betas: dict[str, float]
    intercept: float
    missing_woe: dict[str, float] = field(default_factory=dict)
    mean_woe: dict[str, float] = field(default_factory=dict)

    @property
    def features(self) -> Sequence[str]:
        return tuple(self.betas)

    def edges(self, feature: str) -> list[float]:
        """Inner edges; bins are closed on the left."""
        return [b.lo for b in self.bins[feature][1:]]

    def bins_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f, i, b.lo, b.hi, b.woe) for f, bs in self.bins.items() for i, b in enumerate(bs)
        ]
        return spark.createDataFrame(rows, "feature string, bin_id int, lo double, hi double, woe double")

    def coefficients(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.betas.items()), "feature string, beta double")


def card(edges: dict[str, Sequence[float]], woes: dict[str, Sequence[float]], **rest) -> Scorecard:
    bins = {}
    for f, inner in edges.items():
        lows, highs = [-INF, *inner], [*inner, INF]
        bins[f] = tuple(Bin(lo, hi, w) for lo, hi, w in zip(lows, highs, woes[f], strict=True))
    return Scorecard(bins=bins, **rest)


def woe_of(model: Scorecard, feature: str, missing: str = "neutral", value: Column | None = None) -> Column:
    """CASE over the bins; a missing value counts 0 (neutral) or the bin fitted for it (empirical)."""
    x = F.col(feature) if value is None else value
    out = F.lit(model.bins[feature][-1].woe)
    for b in reversed(model.bins[feature][:-1]):
        out = F.when(x < b.hi, F.lit(b.woe)).otherwise(out)
    empty = model.missing_woe.get(feature, 0.0) if missing == "empirical" else 0.0
    return F.when(x.isNull(), F.lit(empty)).otherwise(out)


def with_woe(df: DataFrame, model: Scorecard, missing: str = "neutral", suffix: str = "_woe") -> DataFrame:
    woes = {f + suffix: woe_of(model, f, missing) for f in model.features}
    return df.withColumns(woes)


def log_odds(model: Scorecard, suffix: str = "_woe") -> Column:
    z = F.lit(model.intercept)
    for f, beta in model.betas.items():
        z = z + F.lit(beta) * F.col(f + suffix)
    return z


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def predict_proba(z: Column) -> Column:
    return clip(sigmoid(z), V.PROB_EPS, 1 - V.PROB_EPS)


def regulatory_pd(z: Column) -> Column:
    """PD with its floor and cap."""
    return clip(sigmoid(z), V.PD_FLOOR, V.PD_CAP)


def good_odds(pd: Column) -> Column:
    p = clip(pd, V.PD_FLOOR, V.PD_CAP)
    return (1 - p) / p


def pd_band(pd: Column) -> Column:
    return ladder(pd, V.PD_BANDS)


def tier(pd: Column) -> Column:
    return ladder(pd, V.RISK_TIERS)


def to_score(z: Column) -> Column:
    """Offset - Factor * log-odds, clipped and truncated: riskier means lower."""
    raw = F.lit(V.OFFSET) - F.lit(V.FACTOR) * z
    return F.floor(clip(raw, float(V.SCORE_MIN), float(V.SCORE_MAX))).cast("int")


def to_score_alt(z: Column) -> Column:
    """The other published sign and base odds, for comparison only."""
    raw = F.lit(V.ALT_OFFSET) + F.lit(V.FACTOR) * z
    return F.floor(clip(raw, float(V.SCORE_MIN), float(V.SCORE_MAX))).cast("int")


def feature_points(model: Scorecard, feature: str, suffix: str = "_woe") -> Column:
    """Share of the score of one feature: its points and an equal part of the offset.

    Points carry the score's own sign; the intercept is not distributed.
    """
    share = V.OFFSET / len(model.betas)
    return F.lit(-V.FACTOR * model.betas[feature]) * F.col(feature + suffix) + F.lit(share)


def coverage(bank: Column, salary: Column, utility: Column) -> Column:
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    return part(bank, 0.6) + part(salary, 0.2) + part(utility, 0.2)


def data_quality(features: Sequence[str] = V.FEATURES) -> Column:
    n = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
    return n / len(features)


def certainty(pd: Column) -> Column:
    return F.abs(pd - 0.5) * 2


def confidence_product(cov: Column, quality: Column, fraud: Column, pd: Column) -> tuple[Column, Column]:
    """Product of four parts in percent, with its band."""
    pct = rnd(cov * quality * clip(fraud, 0.0, 1.0) * certainty(pd) * 100, 2)
    band = (
        F.when(pct >= 80, "High Confidence")
        .when(pct >= 50, "Moderate Confidence")
        .when(pct >= 20, "Low Confidence — Manual Review Recommended")
        .otherwise("Very Low Confidence — Do Not Automate Decision")
    )
    return pct, band


def confidence_weighted(cov: Column, quality: Column, pd: Column) -> tuple[Column, Column]:
    """Weighted mean of three parts in percent, with its band."""
    share = 0.4 * cov + 0.3 * quality + 0.3 * certainty(pd)
    band = (
        F.when(share >= 0.75, "High Confidence")
        .when(share >= 0.50, "Moderate Confidence")
        .otherwise("Low Confidence")
    )
    return rnd(share * 100, 2), band


def score_batch(applicants: DataFrame, model: Scorecard, missing: str = "neutral") -> DataFrame:
    """Score every applicant: WoE, log-odds, PD, score, tier, PD band, confidence."""
    scored = with_woe(applicants, model, missing).withColumn("log_odds", log_odds(model))
    scored = scored.withColumn("pd", predict_proba(F.col("log_odds")))
    pct, band = confidence_weighted(
        coverage(F.col("has_bank"), F.col("has_salary"), F.col("has_utility")), data_quality(), F.col("pd")
    )
    return scored.withColumns(
        {
            "risk_score": to_score(F.col("log_odds")),
            "risk_tier": tier(F.col("pd")),
            "pd_band": pd_band(F.col("pd")),
            "confidence_pct": pct,
            "confidence_band": band,
        }
    )


def what_if(applicants: DataFrame, model: Scorecard, scenarios: Sequence[dict]) -> DataFrame:
    """Re-score everyone under each scenario; NULL keeps the applicant's own value."""
    names = ("cashflow_cv", "credit_debit_ratio", "net_to_gross_ratio", "pf_contribution_flag")
    structs = []
    for i, s in enumerate(scenarios, 1):
        kinds = {n: "boolean" if n.endswith("_flag") else "double" for n in names}
        structs.append(
            F.struct(
                F.lit(i).alias("scenario_id"),
                *[F.lit(s.get(n)).cast(k).alias("new_" + n) for n, k in kinds.items()],
            )
        )
    base = score_batch(applicants, model)
    tried = base.select(
        "account_id", *model.features, "has_bank", "has_salary", "has_utility",
        F.col("risk_score").alias("base_score"), F.col("risk_tier").alias("base_tier"),
        F.inline(F.array(*structs)),
    )
    for n in names:
        if n in model.features:
            tried = tried.withColumn(n, F.coalesce("new_" + n, n))
    again = score_batch(tried, model)
    return again.select(
        "account_id", "scenario_id", "base_score", F.col("risk_score").alias("new_score"),
        (F.col("risk_score") - F.col("base_score")).alias("delta"),
        F.when(F.col("risk_tier") != F.col("base_tier"), F.concat("base_tier", F.lit(" → "), "risk_tier")).alias("delta_tier"),
    )
