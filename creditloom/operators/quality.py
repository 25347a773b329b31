"""Row quality: per-field scores, row confidence, issues and review flag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fields as X
from ..functions.columns import compact, rnd
from ..functions.vocab import QUALITY_RULES, REVIEW_BELOW

# Kind -> (test, penalty, what the issue says).
CHECKS = {
    "date": (lambda c: X.parse_date(c).isNotNull(), 0.4, "invalid date"),
    "float": (X.is_float, 0.5, "not numeric"),
    "cr_dr": (X.is_crdr, 0.4, "must be CR/DR"),
    "str": (X.is_text, 0.2, "empty"),
}
MISSING_OPTIONAL = 0.8


@dataclass(frozen=True)
class FieldRule:
    name: str
    mandatory: bool
    kind: str
    low: float | None = None
    high: float | None = None

    def verdict(self, enforce_ranges: bool = False) -> tuple[Column, Column]:
        """(score, issue or NULL) of this field in each row."""
        raw = F.col(self.name).cast("string")
        test, penalty, words = CHECKS[self.kind]
        good = test(raw)
        if enforce_ranges and self.kind == "float" and self.low is not None:
            value = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
            good = good & value.between(self.low, self.high)
        missing = F.coalesce(F.trim(raw) == "", F.lit(True))
        score = F.when(missing, 0.0 if self.mandatory else MISSING_OPTIONAL).when(good, 1.0).otherwise(1.0 - penalty)
        issue = F.when(missing, f"{self.name} missing" if self.mandatory else None).when(
            ~good, f"{self.name} {words}"
        )
        return score, issue


def rules(source: str) -> list[FieldRule]:
    return [FieldRule(*spec) for spec in QUALITY_RULES[source]]


def field_scores(df: DataFrame, source: str, key: str, enforce_ranges: bool = False) -> DataFrame:
    """Long form: one row per record and field."""
    items = []
    for rule in rules(source):
        score, issue = rule.verdict(enforce_ranges)
        items.append(F.struct(F.lit(rule.name).alias("field"), score.alias("score"), issue.alias("issue")))
    return df.select(key, F.inline(F.array(*items)))


def check_rows(df: DataFrame, source: str, enforce_ranges: bool = False) -> DataFrame:
    """The rows plus confidence_score, issues and review_required."""
    verdicts = [rule.verdict(enforce_ranges) for rule in rules(source)]
    total = sum((score for score, _ in verdicts), F.lit(0.0))
    confidence = rnd(total / len(verdicts), 4)
    return df.select(
        "*",
        confidence.alias("confidence_score"),
        F.array_join(compact(*[issue for _, issue in verdicts]), "; ").alias("issues"),
        (confidence < REVIEW_BELOW).alias("review_required"),
    )
