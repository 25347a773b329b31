"""Supervised binning: quantile pre-bins on the cluster, an exact merge on a tiny table.

Counting is the distributed part: all features are folded to distinct values in
one aggregation, from which both the pre-bin edges and the pre-bin counts come.
What is left is at most ``MAX_PREBINS`` + 1 rows per feature.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vocab as V
from ..functions.columns import ladder, rnd
from ..session import cut_lineage
from . import ordered as O
from .assembly import unpivot_features
from .scoring import INF, Bin, Scorecard

# Functions sent to Python workers travel by value: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MISSING_BIN = -1
BIN_SCHEMA = (
    "feature string, bin_id int, lo double, hi double, n_event bigint, n_nonevent bigint, "
    "woe double, iv double"
)


def _require(df: DataFrame, features: Sequence[str]) -> None:
    for f in features:
        if f not in df.columns:
            raise ValueError(f"feature {f} not found in input data")


def prebin_counts(df: DataFrame, label: str = "default", features: Sequence[str] = V.FEATURES) -> DataFrame:
    """(feature, prebin, lo, hi, n, bad); missing values under ``MISSING_BIN``."""
    _require(df, features)
    long = unpivot_features(df, label, features=features).where(F.col(label).isin(0, 1))
    bad = F.count_if(F.col(label) == 1)
    rows = F.count(F.lit(1))
    known = long.where(F.col("value").isNotNull())
    # Edges and counts both read this table, so it is written once.
    table = cut_lineage(O.cumulate(known, "feature", "value", {"n": rows, "bad": bad}))
    probs = [i / MAX for i in range(1, MAX)]
    edges = O.quantiles(table, "feature", "value", probs).select("feature", F.array_distinct("edges").alias("edges"))
    place = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    # One row of edges per feature, so the broadcast side has a fixed size.
    known = (
        table.join(F.broadcast(edges), "feature")
        .withColumn("prebin", place)
        .groupBy("feature", "prebin")
        .agg(
            F.max(F.try_element_at("edges", F.when(place > 0, place))).alias("lo"),
            F.max(F.try_element_at("edges", place + 1)).alias("hi"),
            F.sum("n").alias("n"),
            F.sum("bad").alias("bad"),
        )
    )
    unknown = (
        long.where(F.col("value").isNull())
        .groupBy("feature")
        .agg(rows.alias("n"), bad.alias("bad"))
        .select(
            "feature", F.lit(MISSING_BIN).alias("prebin"), F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"), "n", "bad",
        )
    )
    return known.unionByName(unknown)


MAX = V.MAX_PREBINS


def _evidence(bad, good, all_bad, all_good):
    """(WoE, IV) of a bin; an empty cell counts half a row."""
    half = np.where((bad == 0) | (good == 0), 0.5, 0.0)
    share_bad, share_good = (bad + half) / all_bad, (good + half) / all_good
    woe = np.log(share_good / share_bad)
    return woe, (share_good - share_bad) * woe


def merge_prebins(pdf: pd.DataFrame, max_bins: int = V.MAX_BINS, min_share: float = V.MIN_BIN_SHARE, trend: str = "auto") -> pd.DataFrame:
    """Exact best merge of one feature's pre-bins under bin size and monotone WoE.

    ``best[j]`` keeps, per (number of bins, start of the last bin), the highest IV of
    the first j pre-bins; both directions are tried and the higher IV is kept.
    """
    feature = pdf["feature"].iloc[0]
    pre = pdf[pdf["prebin"] != MISSING_BIN].sort_values("prebin")
    lost = pdf[pdf["prebin"] == MISSING_BIN]
    all_bad = max(float(pdf["bad"].sum()), 0.5)
    all_good = max(float((pdf["n"] - pdf["bad"]).sum()), 0.5)
    n = np.concatenate([[0], pre["n"].cumsum()]).astype(float)
    b = np.concatenate([[0], pre["bad"].cumsum()]).astype(float)
    m = len(pre)
    size = n[None, :] - n[:, None]
    bad = b[None, :] - b[:, None]
    with np.errstate(all="ignore"):
        woe, iv = _evidence(bad, size - bad, all_bad, all_good)
    wide = size >= min_share * n[-1]

    def search(sign: float):
        best: list[dict] = [{} for _ in range(m + 1)]
        for j in range(1, m + 1):
            for i in range(j):
                if not wide[i, j]:
                    continue
                options = [(1, iv[i, j], (j,))] if i == 0 else [
                    (k + 1, total + iv[i, j], path + (j,))
                    for (k, h), (total, path) in best[i].items()
                    if k < max_bins and sign * woe[h, i] <= sign * woe[i, j]
                ]
                for k, total, path in options:
                    old = best[j].get((k, i))
                    if old is None or (round(total, 9), tuple(-x for x in path)) > (round(old[0], 9), tuple(-x for x in old[1])):
                        best[j][(k, i)] = (total, path)
        return [(round(total, 9), -k, tuple(-x for x in path)) for (k, _), (total, path) in best[m].items()]

    signs = {"auto": (1.0, -1.0), "ascending": (1.0,), "descending": (-1.0,)}[trend]
    found = [x for s in signs for x in search(s)] if m else []
    ends = [-x for x in max(found)[2]] if found else ([m] if m else [])
    rows, start = [], 0
    lows, highs = pre["lo"].to_list(), pre["hi"].to_list()
    for bin_id, end in enumerate(ends):
        ev, cnt = bad[start, end], size[start, end]
        rows.append(
            (
                feature, bin_id, lows[start] if start else -INF, highs[end - 1] if end < m else INF,
                int(ev), int(cnt - ev), float(woe[start, end]), float(iv[start, end]),
            )
        )
        start = end
    for _, x in lost.iterrows():
        w, v = _evidence(np.float64(x["bad"]), np.float64(x["n"] - x["bad"]), all_bad, all_good)
        rows.append((feature, MISSING_BIN, None, None, int(x["bad"]), int(x["n"] - x["bad"]), float(w), float(v)))
    return pd.DataFrame(rows, columns=["feature", "bin_id", "lo", "hi", "n_event", "n_nonevent", "woe", "iv"])


def fit_bins(df: DataFrame, label: str = "default", features: Sequence[str] = V.FEATURES, trend: str = "auto") -> DataFrame:
    """The bins table of every feature.  Each group holds at most 21 rows."""
    counts = prebin_counts(df, label, features)
    return counts.groupBy("feature").applyInPandas(lambda pdf: merge_prebins(pdf, trend=trend), BIN_SCHEMA)


def weak_features(bins: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Features whose information value is below the threshold."""
    return bins.groupBy("feature").agg(F.sum("iv").alias("iv")).where(F.col("iv") < threshold)


def bins_at_edges(df: DataFrame, model: Scorecard, label: str = "default") -> DataFrame:
    """Bins table counted at given edges: one aggregation with a few keys per feature."""
    _require(df, model.features)
    items = []
    for f in model.features:
        place: Column = F.lit(0)
        for e in model.edges(f):
            place = place + (F.col(f) >= e).cast("int")
        items.append(F.struct(F.lit(f).alias("feature"), F.coalesce(place, F.lit(MISSING_BIN)).alias("bin_id")))
    y = F.col(label)
    counts = (
        df.select(label, F.inline(F.array(*items)))
        .groupBy("feature", "bin_id")
        .agg(F.count_if(y == 1).alias("n_event"), F.count_if(y == 0).alias("n_nonevent"))
    )
    return add_evidence(counts)


def add_evidence(counts: DataFrame) -> DataFrame:
    """WoE = ln(good share / bad share) and IV of every bin."""
    every = W.partitionBy("feature")
    ev, non = F.col("n_event"), F.col("n_nonevent")
    half = F.when((ev == 0) | (non == 0), 0.5).otherwise(0.0)
    bad = (ev + half) / F.sum("n_event").over(every)
    good = (non + half) / F.sum("n_nonevent").over(every)
    return counts.select("*", bad.alias("_b"), good.alias("_g")).select(
        *counts.columns,
        F.log(F.col("_g") / F.col("_b")).alias("woe"),
        ((F.col("_g") - F.col("_b")) * F.log(F.col("_g") / F.col("_b"))).alias("iv"),
    )


def monotone(bins: DataFrame) -> DataFrame:
    """Feature -> is the WoE monotone over its ordered bins."""
    prev = F.lag("woe").over(W.partitionBy("feature").orderBy("bin_id"))
    steps = bins.where(F.col("bin_id") != MISSING_BIN).withColumn("prev", prev)
    up = F.bool_and(F.coalesce(F.col("prev") <= F.col("woe"), F.lit(True)))
    down = F.bool_and(F.coalesce(F.col("prev") >= F.col("woe"), F.lit(True)))
    return steps.groupBy("feature").agg((up | down).alias("is_monotone"))


def iv_summary(bins: DataFrame) -> DataFrame:
    s = bins.groupBy("feature").agg(
        F.sum("iv").alias("iv"), F.count_if(F.col("bin_id") != MISSING_BIN).alias("n_bins")
    )
    return s.select(
        "feature", rnd(F.col("iv"), 4).alias("iv"), "n_bins", ladder(F.col("iv"), V.IV_STRENGTH).alias("strength")
    )


def to_scorecard(bins: DataFrame, betas: dict[str, float] | None = None, intercept: float = 0.0) -> Scorecard:
    """Model object from a bins table (at most 7 rows per feature come to the driver)."""
    by: dict[str, list] = {}
    missing: dict[str, float] = {}
    for r in bins.orderBy("feature", "bin_id").collect():
        if r.bin_id == MISSING_BIN:
            missing[r.feature] = r.woe
        else:
            by.setdefault(r.feature, []).append(Bin(r.lo, r.hi, r.woe))
    order = [f for f in V.FEATURES if f in by] + sorted(set(by) - set(V.FEATURES))
    return Scorecard(
        bins={f: tuple(by[f]) for f in order},
        betas={f: (betas or {}).get(f, 1.0) for f in order},
        intercept=intercept,
        missing_woe=missing,
    )


def scorecard_points(bins: DataFrame, coefficients: DataFrame) -> DataFrame:
    """feature x bin: WoE, coefficient and points (score sign, equal share of the offset)."""
    n = coefficients.count()
    points = F.lit(-V.FACTOR) * F.col("beta") * F.col("woe") + F.lit(V.OFFSET / n)
    return bins.join(coefficients, "feature").select(
        "feature", "bin_id", rnd(F.col("woe"), 4).alias("woe"), rnd(F.col("beta"), 6).alias("beta"), rnd(points, 1).alias("points")
    )
