"""Evaluation jobs: confusion counts, precision and recall, thresholds, field accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import rnd


def confusion(df: DataFrame, truth: str, guess: str, *by: str) -> DataFrame:
    y, g = F.col(truth) == 1, F.col(guess) == 1
    return df.groupBy(*by).agg(
        F.count_if(y & g).alias("tp"),
        F.count_if(~y & ~g).alias("tn"),
        F.count_if(~y & g).alias("fp"),
        F.count_if(y & ~g).alias("fn"),
    )


def _share(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(F.try_divide(top, bottom))


def precision_recall(counts: DataFrame, digits: int = 3) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where a denominator is 0."""
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return counts.select(
        *[x for x in counts.columns if x not in ("tp", "tn", "fp", "fn")],
        rnd(_share(tp + tn, tp + tn + fp + fn), digits).alias("accuracy"),
        rnd(_share(tp, tp + fp), digits).alias("precision"),
        rnd(_share(tp, tp + fn), digits).alias("recall"),
        rnd(_share(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
    )


def at_thresholds(df: DataFrame, truth: str, prob: str, cuts: Sequence[float]) -> DataFrame:
    """Precision and recall at each cut (strictly above counts as positive), in one aggregate."""
    guess = F.transform(
        F.array(*[F.lit(x) for x in cuts]),
        lambda t: F.struct(t.alias("threshold"), F.when(F.col(prob) > t, 1).otherwise(0).alias("guess")),
    )
    return precision_recall(confusion(df.select(truth, F.inline(guess)), truth, "guess", "threshold"))


def errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Only the wrong rows, tagged false positive or false negative."""
    kind = F.when((F.col(truth) == 0) & (F.col(guess) == 1), "false positive").when(
        (F.col(truth) == 1) & (F.col(guess) == 0), "false negative"
    )
    return df.withColumn("error", kind).where(F.col("error").isNotNull())


def same_chars(a: str, b: str) -> Column:
    """Equal characters at equal positions over the longer length."""
    hits = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    longest = F.greatest(F.length(a), F.length(b))
    n = F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.aggregate(hits, F.lit(0), lambda s, x: s + x))
    return F.try_divide(n, longest)


def tamper_guess(a: str, b: str) -> Column:
    return F.when(F.col(a).eqNullSafe(F.col(b)), "clean").otherwise("tampered")
