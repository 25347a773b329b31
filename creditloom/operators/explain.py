"""Exact linear explanations: SHAP values, reason codes, adverse-action text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import rnd
from ..functions.vocab import FACTOR, FEATURE_LABELS
from .scoring import Scorecard

TOP_REASONS = 4
# The lines of an adverse-action notice.
NOTICE_HEAD = "Your credit assessment was affected by the following factors:"
NOTICE_NONE = "  No adverse factors identified — all signals are positive."


def mean_woe(df: DataFrame, model: Scorecard) -> dict[str, float]:
    """Mean WoE per feature over a training frame: one aggregate, five numbers."""
    row = df.agg(*[F.avg(f + "_woe").alias(f) for f in model.features]).first()
    return row.asDict()


def shap_value(model: Scorecard, feature: str) -> Column:
    return F.lit(model.betas[feature]) * (F.col(feature + "_woe") - F.lit(model.mean_woe[feature]))


def with_shap(df: DataFrame, model: Scorecard) -> DataFrame:
    return df.withColumns({f + "_shap": shap_value(model, f) for f in model.features})


def label_of(feature: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in FEATURE_LABELS.items() for x in kv])[feature]


def _top(items: list[Column], n: int) -> Column:
    """The n items of greatest size; equal sizes keep the model order."""
    ranked = F.array_sort(
        F.array(*items),
        lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).otherwise(a["place"] - b["place"]),
    )
    return F.slice(ranked, 1, n)


def shap_reasons(model: Scorecard, n: int = TOP_REASONS) -> Column:
    """Top reasons by absolute SHAP value; "positive" raises the odds of default."""
    items = []
    for i, f in enumerate(model.features):
        v = F.col(f + "_shap")
        items.append(
            F.struct(
                F.lit(f).alias("feature"), F.lit(FEATURE_LABELS[f]).alias("label"), rnd(v, 4).alias("value"),
                F.when(v > 0, "positive").otherwise("negative").alias("direction"),
                F.abs(v).alias("size"), F.lit(i).alias("place"),
            )
        )
    return _top(items, n)


def point_reasons(model: Scorecard, n: int = TOP_REASONS) -> Column:
    """Top reasons by score points: negative points hurt the score."""
    items = []
    for i, f in enumerate(model.features):
        points = F.lit(-FACTOR) * F.lit(model.betas[f]) * F.col(f + "_woe")
        items.append(
            F.struct(
                F.lit(f).alias("feature"), F.lit(FEATURE_LABELS[f]).alias("label"), rnd(points, 2).alias("value"),
                F.when(points > 0, "positive").otherwise("negative").alias("direction"),
                F.abs(rnd(points, 2)).alias("size"), F.lit(i).alias("place"),
                F.col(f + "_woe").alias("woe"), F.lit(model.betas[f]).alias("coefficient"),
            )
        )
    return _top(items, n)


def adverse_notice(reasons: str) -> Column:
    """Numbered text of the reasons that hurt, or the line that says there are none."""
    bad = F.filter(reasons, lambda x: x["direction"] == "negative")
    lines = F.transform(
        bad,
        lambda x, i: F.format_string("  %d. %s (impact: %.4f)", i + 1, x["label"], x["value"]),
    )
    lines = F.when(F.size(bad) == 0, F.array(F.lit(NOTICE_NONE))).otherwise(lines)
    return F.array_join(F.concat(F.array(F.lit(NOTICE_HEAD)), lines), "\n")


def population_summary(df: DataFrame, model: Scorecard) -> DataFrame:
    """Mean absolute and mean SHAP per feature, ranked."""
    sums = df.agg(
        *[F.avg(F.abs(F.col(f + "_shap"))).alias("a_" + f) for f in model.features],
        *[F.avg(f + "_shap").alias("m_" + f) for f in model.features],
    )
    rows = [
        F.struct(
            F.lit(f).alias("feature"), F.lit(FEATURE_LABELS[f]).alias("label"),
            rnd(F.col("a_" + f), 4).alias("mean_abs_shap"), rnd(F.col("m_" + f), 4).alias("mean_shap"),
        )
        for f in model.features
    ]
    order = W.partitionBy(F.lit(1)).orderBy(F.desc("mean_abs_shap"), "feature")
    return sums.select(F.inline(F.array(*rows))).withColumn("rank", F.row_number().over(order))
