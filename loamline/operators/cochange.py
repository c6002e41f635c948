"""Files or features that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pairs(items: DataFrame, *, sha: str = "sha", item: str = "path", bulk: int = 30, least_activity: int = 1) -> DataFrame:
    """(f1, f2, n, c1, c2, score) with f1 < f2: commits of both, of each, and their Jaccard score, unrounded.

    Commits with more than `bulk` items are left out first, which bounds what a commit can emit.
    """
    once = items.select(F.col(sha).alias("sha"), F.col(item).alias("item")).distinct()
    size = F.count(F.lit(1)).over(W.partitionBy("sha"))
    kept = once.withColumn("size", size).where(F.col("size") <= bulk).select("sha", "item")
    activity = kept.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    lists = kept.groupBy("sha").agg(F.array_sort(F.collect_list("item")).alias("xs")).where(F.size("xs") > 1)
    both = lists.select(F.posexplode("xs").alias("i", "f1"), "xs").select("f1", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("f2"))
    n = both.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"))
    a = activity.where(F.col("c") >= least_activity)
    met = n.join(a.select(F.col("item").alias("f1"), F.col("c").alias("c1")), "f1").join(a.select(F.col("item").alias("f2"), F.col("c").alias("c2")), "f2")
    return met.select("f1", "f2", "n", "c1", "c2", (F.col("n") / (F.col("c1") + F.col("c2") - F.col("n"))).alias("score"))


def top_pairs(scored: DataFrame, *, least_count: int = 2, least_score: float = 0.25, most: int = 40) -> DataFrame:
    """The strongest pairs; the threshold is on the unrounded score, the order on the rounded one, then by name."""
    kept = scored.where((F.col("n") >= least_count) & (F.col("score") >= least_score)).withColumn("score", F.round("score", 2))
    return kept.orderBy(F.desc("score"), "f1", "f2").limit(most)


def missing_partners(scored: DataFrame, change: DataFrame, *, least_score: float = 0.15, most: int = 10) -> DataFrame:
    """(path, score, confidence) of files outside the change that usually change with a file in it."""
    strong = scored.where(F.col("score") >= least_score)
    both = strong.select("f1", "f2", "score").unionByName(strong.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "score"))
    inside = change.select(F.col("path").alias("f1")).distinct()
    outside = both.join(inside, "f1").join(change.select(F.col("path").alias("f2")), "f2", "left_anti")
    best = outside.groupBy(F.col("f2").alias("path")).agg(F.max("score").alias("score"))
    level = F.when(F.col("score") >= 0.5, "high").when(F.col("score") >= 0.25, "medium").otherwise("low")
    return best.orderBy(F.desc("score"), "path").limit(most).select("path", F.round("score", 6).alias("score"), level.alias("confidence"))
