"""Snapshots, changes between them, and what has to be refreshed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from .graph import sized


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash", unchanged: bool = False) -> DataFrame:
    """(key, status): added, removed or modified (and unchanged, if asked for) between two snapshots."""
    a, b = old.select(key, F.col(digest).alias("was"), F.lit(True).alias("before")), new.select(key, F.col(digest).alias("now"), F.lit(True).alias("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("modified")
    out = a.join(b, key, "full").select(key, status.alias("status"))
    return out if unchanged else out.where("status <> 'unchanged'")


def feature_plan(feature_files: DataFrame, diff: DataFrame) -> DataFrame:
    """(feature, files, changed, removed, plan): features to carry over (clean), scan anew (stale) or drop (all files gone)."""
    met = feature_files.select("feature", "path").join(diff, "path", "left")
    n = met.groupBy("feature").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "modified").alias("changed"), F.count_if(F.col("status") == "removed").alias("removed"))
    return n.withColumn("plan", F.when(F.col("removed") == F.col("files"), "deleted").when(F.col("changed") + F.col("removed") > 0, "stale").otherwise("clean"))


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, name, status): symbols added, removed or modified between two snapshots (path, name, hash)."""
    a, b = old.select("path", "name", F.col("hash").alias("was"), F.lit(True).alias("before")), new.select("path", "name", F.col("hash").alias("now"), F.lit(True).alias("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return a.join(b, ["path", "name"], "full").select("path", "name", status.alias("status")).where("status is not null")


def symbol_delta(changes: DataFrame) -> DataFrame:
    """(path, added, removed, modified, structural): what changed in each file that changed; structural if symbols came or went, so that they have to be attributed anew."""
    n = changes.groupBy("path").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified")])
    return n.withColumn("structural", F.col("added") + F.col("removed") > 0)


def kept_attributions(attributions: DataFrame, changes: DataFrame) -> DataFrame:
    """Attributions (path, name, ...) without those of symbols that are gone."""
    return attributions.join(changes.where("status = 'removed'").select("path", "name"), ["path", "name"], "left_anti")


def fresh_files(diff: DataFrame, feature_files: DataFrame) -> DataFrame:
    """Added files that no feature has yet."""
    return diff.where("status = 'added'").join(feature_files.select("path"), "path", "left_anti").select("path")


def nearest_owner(paths: DataFrame, feature_files: DataFrame) -> DataFrame:
    """(path, feature, how): the owner by exact path, else of the nearest directory above with one (first by name), else null."""
    exact = feature_files.groupBy("path").agg(F.max("feature").alias("own")).hint("merge")
    dirs = sized(feature_files.select("feature", P.parent(F.col("path")).alias("dir")).groupBy("dir").agg(F.min("feature").alias("near")))
    parts = F.split("path", "/")
    above = paths.select("path").distinct().where(F.col("path").contains("/")).select("path", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("depth"))
    up = above.withColumn("dir", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/")).join(dirs, "dir").groupBy("path").agg(F.max_by("near", "depth").alias("near")).hint("merge")
    met = paths.select("path").distinct().join(exact, "path", "left").join(up, "path", "left")
    how = F.when(F.col("own").isNotNull(), "exact").when(F.col("near").isNotNull(), "ancestor")
    return met.select("path", F.coalesce("own", "near").alias("feature"), how.alias("how"))


def sessions(events: DataFrame, gap_seconds: int, keys: list[str]) -> DataFrame:
    """(keys, started, ended, n): bursts of events with less than `gap_seconds` of silence inside; the batch form of the streaming debounce."""
    w = W.partitionBy(*keys).orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    fresh = F.when(before.isNull() | (F.col("ts") >= before + F.make_dt_interval(secs=F.lit(gap_seconds))), 1).otherwise(0)
    own = events.withColumn("fresh", fresh).withColumn("burst", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return own.groupBy(*keys, "burst").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")).drop("burst")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
