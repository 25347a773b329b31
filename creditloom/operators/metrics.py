"""Model validation: KS, AUC, Gini, Hosmer-Lemeshow, calibration, score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vocab as V
from ..functions.columns import rnd
from ..functions.stats import chi2_sf
from ..session import cut_lineage
from . import ordered as O

DECILES = [i / 10 for i in range(11)]
EPS = 1e-8
CALIBRATED_BELOW = 0.05
OVERFIT_GAP = 0.03


def label_table(df: DataFrame, truth: str, prob: str, group: str) -> DataFrame:
    """Running bads and goods over the distinct scores of each group, ascending.

    Every metric reads this table several times, so it is checkpointed: the
    applicants are scored once, and what is kept is one row per distinct score.
    """
    y = F.col(truth)
    table = O.cumulate(
        df.where(y.isin(0, 1) & F.col(prob).isNotNull()),
        group,
        prob,
        {"n": F.count(F.lit(1)), "bad": F.count_if(y == 1), "good": F.count_if(y == 0)},
    )
    return cut_lineage(table)


def ks_curve(table: DataFrame, group: str, prob: str) -> DataFrame:
    """Cumulative shares from the highest score down; ties share one step."""
    down = lambda c: F.col(f"total_{c}") - F.col(f"cum_{c}") + F.col(c)
    return table.select(
        group,
        prob,
        (down("bad") / (F.col("total_bad") + EPS)).alias("cum_bad_share"),
        (down("good") / (F.col("total_good") + EPS)).alias("cum_good_share"),
    )


def ks(table: DataFrame, group: str, prob: str) -> DataFrame:
    gap = F.abs(F.col("cum_bad_share") - F.col("cum_good_share"))
    return ks_curve(table, group, prob).groupBy(group).agg(rnd(F.max(gap) * 100, 2).alias("ks"))


def auc(table: DataFrame, group: str) -> DataFrame:
    """Mann-Whitney with tie averaging, from integer counts."""
    below = F.col("cum_good") - F.col("good")
    wins = F.sum(F.col("bad") * (2 * below + F.col("good")))
    pairs = F.max(F.col("total_bad") * F.col("total_good"))
    return table.groupBy(group).agg(F.try_divide(wins / 2, pairs).alias("auc"))


def gini(table: DataFrame, group: str) -> DataFrame:
    return auc(table, group).select(
        group, rnd(F.col("auc"), 4).alias("auc"), rnd(2 * F.col("auc") - 1, 4).alias("gini")
    )


def quantile_bins(table: DataFrame, group: str, prob: str, probs=DECILES) -> DataFrame:
    """The distinct scores with their quantile bin (right-closed, lowest value included)."""
    edges = O.quantiles(table, group, prob, probs).withColumn("edges", F.array_distinct("edges"))
    above = lambda e: e < F.col(prob)
    inner = F.size(F.filter("edges", above))
    return table.join(F.broadcast(edges), group).withColumn("bin", F.greatest(inner, F.lit(1)))


def bin_sums(table: DataFrame, group: str, prob: str) -> DataFrame:
    return quantile_bins(table, group, prob).groupBy(group, "bin").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("obs"), F.sum(F.col(prob) * F.col("n")).alias("exp")
    )


def hosmer_lemeshow(table: DataFrame, group: str, prob: str) -> DataFrame:
    """Event-term statistic, its tail with bins - 2 degrees of freedom, and the full textbook form."""
    obs, exp, n = F.col("obs"), F.col("exp"), F.col("n")
    s = bin_sums(table, group, prob).groupBy(group).agg(
        F.sum((obs - exp) ** 2 / (exp + EPS)).alias("hl"),
        F.sum((obs - exp) ** 2 / (exp + EPS) + (obs - exp) ** 2 / (n - exp + EPS)).alias("hl_full"),
        F.count(F.lit(1)).alias("bins"),
    )
    s = s.withColumn("p", chi2_sf(F.col("hl"), F.col("bins") - 2))
    return s.select(
        group, rnd(F.col("hl"), 4).alias("hl_stat"), rnd(F.col("hl_full"), 4).alias("hl_full"), rnd(F.col("p"), 4).alias("p_value"),
        F.when(F.col("p") > 0.05, "GOOD").otherwise("BAD").alias("calibration"),
    )


def calibration(table: DataFrame, group: str, prob: str) -> DataFrame:
    s = bin_sums(table, group, prob)
    diff = F.col("obs") / F.col("n") - F.col("exp") / F.col("n")
    return s.select(
        group, "bin", "n", rnd(F.col("exp") / F.col("n"), 4).alias("avg_predicted_pd"),
        rnd(F.col("obs") / F.col("n"), 4).alias("observed_default_rate"), rnd(diff, 4).alias("difference"),
        (F.abs(rnd(diff, 4)) < CALIBRATED_BELOW).alias("calibrated"),
    )


def report(df: DataFrame, truth: str, prob: str, group: str = "split") -> DataFrame:
    """AUC, Gini, KS and Hosmer-Lemeshow per split, with the train-test gap."""
    t = label_table(df, truth, prob, group)
    out = gini(t, group).join(ks(t, group, prob), group).join(hosmer_lemeshow(t, group, prob), group)
    both = W.partitionBy(F.lit(1))
    of = lambda name: F.max(F.when(F.col(group) == name, F.col("auc"))).over(both)
    gap = of("train") - of("test")
    return out.withColumn("auc_gap", rnd(gap, 4)).withColumn("overfit", F.col("auc_gap") > OVERFIT_GAP)


def score_bands(df: DataFrame, score: str, pd: str) -> DataFrame:
    """Population per score band; bands are half-open and empty bands do not appear."""
    s = F.col(score)
    band: Column = F.lit(None).cast("string")
    for lo, hi, name in reversed(V.SCORE_BANDS):
        band = F.when((s >= lo) & (s < hi), f"{lo}–{hi} {name}").otherwise(band)
    sums = df.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("avg_score"), F.avg(pd).alias("avg_pd")
    )
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return sums.withColumn("total", total).where(F.col("band").isNotNull()).select(
        "band", "n", rnd(100 * F.col("n") / F.col("total"), 1).alias("pct"),
        rnd(F.col("avg_score"), 1).alias("avg_score"), rnd(F.col("avg_pd"), 4).alias("avg_pd"),
    )
