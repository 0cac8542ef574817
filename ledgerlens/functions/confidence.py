"""Confidence arithmetic and routing rules. Scores are decimals; averages divide exact sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.normalize import SCORE, score
from ledgerlens.functions.text import col


def mean(c: Column | str) -> Column:
    """Aggregate: exact decimal sum over the count, so the result does not depend on partitioning."""
    x = col(c).cast(SCORE)
    return F.try_divide(F.sum(x).cast("double"), F.count(x))


def share(flag: Column) -> Column:
    """Aggregate: part of rows for which ``flag`` holds."""
    return F.try_divide(F.count_if(flag), F.count("*"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0).cast(SCORE), F.least(F.lit(1).cast(SCORE), x)).cast(SCORE)


def header_score(base: Column, value: Column, proximity: Column | None = None, completeness: Column | None = None) -> Column:
    """base * proximity * completeness, halved for values shorter than two characters, within [0, 1]."""
    s = base
    for factor in (proximity, completeness):
        if factor is not None:
            s = (s * factor).cast("decimal(12,8)")
    short = F.coalesce(F.length(F.trim(value)) < 2, F.lit(True))
    return clamp(F.when(short, s / 2).otherwise(s))


def proximity_score(distance: Column) -> Column:
    return F.greatest(score(0.1), (F.lit(1).cast(SCORE) - distance * score(0.15)).cast(SCORE))


# Quality of a value by field kind, (fits, does not fit).
NUMBER_FIELDS = ["subtotal", "vat", "total_amount", "invoice_number"]


def text_quality(value: Column, field_name: Column) -> Column:
    return (
        F.when(value.isNull() | (value == ""), score(0.1))
        .when(field_name.isin(NUMBER_FIELDS), F.when(value.rlike(r"\d"), score(0.9)).otherwise(score(0.3)))
        .when(field_name == "vendor_name", F.when(F.length(value) >= 3, score(0.85)).otherwise(score(0.4)))
        .when(field_name == "invoice_date",
              F.when(value.rlike(r"\d+[/-]\d+[/-]\d+"), score(0.9)).otherwise(score(0.3)))
        .otherwise(score(0.7))
    )


def table_score(mean_cell: Column, pass_rate: Column | None = None, row_quality: Column | None = None) -> Column:
    s = mean_cell
    for factor in (pass_rate, row_quality):
        if factor is not None:
            s = s * factor
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def adjust_for_validation(value: Column, is_valid: Column, penalty: float = 0.15) -> Column:
    return F.when(is_valid, value).otherwise(F.greatest(F.lit(0).cast(SCORE), value - score(penalty))).cast(SCORE)


def adjusted_history(history: Column, value: Column, is_valid: Column, penalty: float = 0.15) -> Column:
    """History array with the lowered score appended when the value was invalid."""
    return F.when(is_valid, history).otherwise(F.concat(history, F.array(adjust_for_validation(value, is_valid, penalty))))


def adjust_confidence(value: Column, adjustment: Column) -> Column:
    """Confidence after a correction; a missing confidence counts 0, a missing adjustment changes nothing."""
    return F.when(adjustment.isNull() | (adjustment == 0), value).otherwise(
        clamp(F.coalesce(value, score(0.0)) + adjustment))


@dataclass(frozen=True)
class RoutingRule:
    high: float
    medium: float
    low_action: str
    require_all: bool


# The three built-in routing rules.
ROUTING_RULES = {
    "default": RoutingRule(0.85, 0.6, "review", False),
    "strict": RoutingRule(0.9, 0.7, "reject", True),
    "lenient": RoutingRule(0.75, 0.5, "review", False),
}


def rule_named(name: str) -> RoutingRule:
    """Unknown names fall back to the default rule."""
    return ROUTING_RULES.get(name, ROUTING_RULES["default"])


def confidence_level(c: Column, rule: RoutingRule) -> Column:
    return F.when(c > rule.high, "high").when(c >= rule.medium, "medium").otherwise("low")


def routing_status(c: Column, rule: RoutingRule) -> Column:
    low = "rejected" if rule.low_action == "reject" else "review_required"
    return F.when(c > rule.high, "approved").when(c >= rule.medium, "review_required").otherwise(low)
