"""Scores and ladders as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days from ts to as_of, rounded down."""
    return F.timestamp_diff("DAY", ts, as_of)


def age_weight(days: Column) -> Column:
    """Recent commits count double, then fade to one half."""
    return F.when(days < 30, F.lit(2.0)).otherwise(F.greatest(F.lit(0.5), F.lit(1.0) - (days - 30) / F.lit(365.0)))


def damped(base: Column, n: Column) -> Column:
    """A score from few commits keeps at least 80 percent."""
    activity = F.least(F.lit(1.0), n / F.lit(50.0))
    return base * activity + base * (F.lit(1.0) - activity) * 0.8


def health(weighted_ratio: Column, n: Column) -> Column:
    """0 to 100, unrounded: logistic in the age-weighted share of fixes, damped by the number of commits; 100 without commits."""
    base = F.lit(100.0) / (F.lit(1.0) + F.exp(F.lit(8.0) * (weighted_ratio - F.lit(0.55))))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(100.0)).otherwise(damped(base, n))


def linear_health(weighted_ratio: Column, weight: Column) -> Column:
    """The linear curve that symbol-weighted health uses."""
    return damped(F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(200.0) * weighted_ratio), weight)


def impact(health_score: Column, views: Column, errors: Column) -> Column:
    """Lower is more urgent: 40 % health, 35 % traffic, 25 % errors, on log scales capped at 100 000 and 10 000."""

    def calm(x: Column, decades: float) -> Column:
        return F.lit(100.0) - F.least(F.log10(F.greatest(x, F.lit(1)).cast("double")) / F.lit(decades), F.lit(1.0)) * 100

    return health_score * 0.4 + calm(views, 5.0) * 0.35 + calm(errors, 4.0) * 0.25


def ladder(value: Column, steps: list[tuple[float, str]], top: str) -> Column:
    """Name of the first step that the value is below, else `top`; null stays null."""
    out = F.when(value.isNull(), None)
    for limit, name in steps:
        out = out.when(value < limit, F.lit(name))
    return out.otherwise(F.lit(top))


def impact_level(score: Column) -> Column:
    return ladder(score, [(25, "critical"), (45, "high"), (65, "medium"), (80, "low")], "healthy")


def health_level(score: Column) -> Column:
    return ladder(score, [(50, "at risk"), (75, "watch")], "good")


def coverage_level(pct: Column) -> Column:
    return ladder(pct, [(40, "low"), (70, "medium")], "high")


def co_change_confidence(score: Column) -> Column:
    return ladder(score, [(0.25, "low"), (0.5, "medium")], "high")


def duration_seconds(commits: Column, *, model: bool = False, flows: bool = False) -> Column:
    return commits * 0.008 + (5 if model else 0) + (80 if flows else 0)


def duration_text(seconds: Column) -> Column:
    return F.when(seconds < 10, "< 10 sec").when(seconds < 60, F.concat(F.lit("~ "), F.floor(seconds).cast("string"), F.lit(" sec"))).otherwise(F.format_string("~ %.1f min", (seconds / 60).cast("double")))


def call_cost(input_tokens: Column, output_tokens: Column, in_rate: Column, out_rate: Column, batch: Column) -> Column:
    """Dollars by rates a million tokens; unknown rates are 3 and 15; batches cost half."""
    cost = input_tokens / F.lit(1e6) * F.coalesce(in_rate, F.lit(3.0)) + output_tokens / F.lit(1e6) * F.coalesce(out_rate, F.lit(15.0))
    return F.when(batch, cost * 0.5).otherwise(cost)


def tokens_saved(features: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(37500) - (F.lit(500) + features * 2500))
