"""All registered queries."""

from .registry import PLANS, SQL
from . import (
    canonical_plans,
    extract_plans,
    feature_plans,
    learner_plans,
    model_plans,
    rule_plans,
    score_plans,
    text_plans,
)

__all__ = ["PLANS", "SQL"]
