"""What a change is likely to break."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affected(feature_files: DataFrame, change: DataFrame) -> DataFrame:
    """(feature, touched): features with files in the change."""
    return feature_files.join(change.select("path").distinct(), "path", "left_semi").groupBy("feature").agg(F.count(F.lit(1)).alias("touched"))


def regression_probability(hit: DataFrame) -> DataFrame:
    """One row: bug ratios of affected features, weighted by how many changed files they have; rounded to two places. hit: (touched, bug_fix_ratio)."""
    return hit.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("bug_fix_ratio") * F.col("touched")), F.sum("touched")), F.lit(0.0)), 2).alias("probability"))


def risk_level(hit: DataFrame, missing: DataFrame, *, critical_health: float = 30, at_risk_health: float = 50, coverage: float = 30) -> DataFrame:
    """One row: number of signals of each kind and the level. hit: (feature, health, coverage, bus_factor); missing: (high), whether a missing partner is likely to be needed."""
    s = hit.agg(
        F.count_if(F.col("health") < critical_health).alias("critical_health"),
        F.count_if((F.col("health") >= critical_health) & (F.col("health") < at_risk_health)).alias("at_risk"),
        F.count_if(F.col("coverage") < coverage).alias("uncovered"),
        F.count_if(F.col("bus_factor") == 1).alias("single_owner"),
    )
    s = s.join(F.broadcast(missing.agg(F.coalesce(F.max(F.col("high").cast("long")), F.lit(0).cast("long")).alias("missing"))), how="cross")  # one row each
    heavy = F.col("critical_health") + F.col("single_owner") + F.col("missing")
    every = heavy + F.col("at_risk") + F.col("uncovered")
    return s.withColumn("level", F.when(heavy >= 2, "critical").when((heavy == 1) | (every >= 3), "high").when(every > 0, "medium").otherwise("low"))
