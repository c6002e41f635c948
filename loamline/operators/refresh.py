"""Bringing a feature map up to date: new commits, new files, and partial scans.

A map is three tables: features (feature, total_commits, bug_fixes, authors, last_modified, health), files
(feature, path) and pull requests (feature, pr_number, sha, ts).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scores as S
from .attribution import weighted_ratio
from .graph import cut, sized
from .incremental import nearest_owner
from .lookups import stem_matches


class FeatureMap(NamedTuple):
    features: DataFrame
    files: DataFrame
    pull_requests: DataFrame


def name_stems(feature: Column) -> Column:
    """Stems under which a feature's new files may go: its name, the parts between hyphens, its singular or plural; three characters and more."""
    other = F.when(feature.endswith("s"), F.regexp_replace(feature, "s$", "")).otherwise(F.concat(feature, F.lit("s")))
    return F.array_distinct(F.filter(F.concat(F.array(feature), F.split(feature, "-"), F.array(other)), lambda s: F.length(s) >= 3))


def new_owner(paths: DataFrame, feature_files: DataFrame) -> DataFrame:
    """(path, feature, how): as nearest_owner; files without an owner above them go by their own stem (`stem`), else by the innermost directory whose name is a feature's (`directory`), else have none."""
    met = cut(nearest_owner(paths, feature_files))
    stems = feature_files.select("feature").distinct().select("feature", F.explode(name_stems(F.col("feature"))).alias("stem"))
    anchors = sized(stems.groupBy("stem").agg(F.min("feature").alias("ord"), F.max("feature").alias("candidate")))
    parts = F.split("path", "/")
    own = P.normal_stem(F.regexp_replace(P.file_name(F.col("path")), r"(?<=.)\.[^.]*$", ""))
    above = F.transform(F.reverse(F.slice(parts, F.lit(1), F.size(parts) - 1)), P.normal_stem)
    tries = cut(met.where("feature is null").select("path", F.posexplode(F.concat(F.array(own), above)).alias("i", "stem")).where("stem <> ''"))
    best = tries.join(stem_matches(tries.select("stem"), anchors).hint("merge"), "stem").groupBy("path").agg(F.min(F.struct("i", "candidate")).alias("b"))
    out = met.join(best.hint("merge"), "path", "left")
    how = F.coalesce("how", F.when(F.col("b.i") == 0, "stem").when(F.col("b.i") > 0, "directory"))
    return out.select("path", F.coalesce("feature", "b.candidate").alias("feature"), how.alias("how"))


def updated(before: FeatureMap, commit_files: DataFrame, commits: DataFrame, as_of: DataFrame) -> FeatureMap:
    """The map with new commits: counters, authors, last change and health of the features that they touch, their new files, and pull requests that fix bugs, each number once with its latest commit.

    A commit counts once for a feature. Health weighs the new commits by age; untouched features stay as
    they are, and files that no feature can take change nothing. commit_files: (sha, path); commits: (sha,
    author, ts, is_bug_fix, pr_number); as_of: one row.
    """
    owner = cut(new_owner(commit_files.select("path"), before.files).where("feature is not null"))
    touched = cut(commit_files.join(owner, "path").select("sha", "feature").distinct().join(commits, "sha"))
    w = S.age_weight(S.age_days(F.col("ts"), F.col("as_of")))
    weighed = touched.crossJoin(F.broadcast(as_of)).withColumn("w", w)  # one row
    new = weighed.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_bug_fix").alias("bugs"), F.collect_set("author").alias("more"), F.max("ts").alias("newest"), weighted_ratio(F.col("is_bug_fix"), F.col("w")).alias("x"))
    met = before.features.join(new, "feature", "left")
    total = F.col("total_commits") + F.coalesce("n", F.lit(0))
    features = met.select(
        "feature", total.alias("total_commits"), (F.col("bug_fixes") + F.coalesce("bugs", F.lit(0))).alias("bug_fixes"), F.array_sort(F.array_union("authors", F.coalesce("more", F.array().cast("array<string>")))).alias("authors"),
        F.greatest("last_modified", "newest").alias("last_modified"), F.when(F.col("n").isNull(), F.col("health")).otherwise(S.health(F.col("x"), total)).alias("health"),
    )
    files = before.files.unionByName(owner.where("how <> 'exact'").select("feature", "path"))
    every = before.pull_requests.unionByName(touched.where("is_bug_fix and pr_number is not null").select("feature", "pr_number", "sha", "ts"))
    last = F.row_number().over(W.partitionBy("feature", "pr_number").orderBy(F.desc("ts"), F.desc("sha")))
    return FeatureMap(features, files, every.withColumn("i", last).where("i = 1").drop("i"))


def stale_files(prior: DataFrame, diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature) of features with a file that changed or went, and (path) of what has to be scanned anew: what is left of their files, and added files that no feature has."""
    stale = cut(prior.join(diff.select("path"), "path").select("feature").distinct())
    gone = diff.where("status = 'removed'").select("path")
    left = prior.join(stale, "feature", "left_semi").select("path").join(gone, "path", "left_anti")
    fresh = diff.where("status = 'added'").select("path").join(prior.select("path"), "path", "left_anti")
    return stale, cut(left.unionByName(fresh).distinct())


def _carried(kept: DataFrame, diff: DataFrame) -> DataFrame:
    return kept.join(diff.where("status = 'removed'").select("path"), "path", "left_anti").select("feature", "path")


def executed(prior: DataFrame, diff: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(feature, path) after a partial scan: what `scan` makes of the stale files, and the other features as they were.

    A feature that the scan names wins over a carried one of that name, and a file that it takes is no
    other's; removed files go, and features with none left. Without anything to scan only removed files go.
    prior: (feature, path); diff: (path, status: added, modified, removed); scan: from (path) to (feature, path).
    """
    stale, todo = stale_files(prior, diff)
    if todo.isEmpty():
        return _carried(prior, diff)
    fresh = cut(scan(todo).select("feature", "path").distinct())
    kept = prior.join(stale, "feature", "left_anti").join(fresh.select("feature").distinct(), "feature", "left_anti").join(fresh.select("path").distinct(), "path", "left_anti")
    return fresh.unionByName(_carried(kept, diff))


def executed_packages(prior: DataFrame, diff: DataFrame, packages: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As executed, for a workspace: packages (package, path) with any changed file are scanned anew; a feature is carried if a clean package has more than half of its files. Without a stale package all stays."""
    stale = cut(packages.join(diff.select("path"), "path", "left_semi").select("package").distinct())
    if stale.isEmpty():
        return prior.select("feature", "path")
    todo = packages.join(stale, "package", "left_semi").select("path").distinct()
    fresh = cut(scan(todo).select("feature", "path").distinct())
    clean = packages.join(stale, "package", "left_anti")
    size = prior.groupBy("feature").agg(F.count(F.lit(1)).alias("size"))
    held = prior.join(clean, "path").groupBy("feature", "package").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.max("n").alias("n"))
    most = held.join(size, "feature").where(F.expr("n >= size div 2 + 1")).select("feature")
    kept = prior.join(most, "feature", "left_semi").join(fresh.select("feature").distinct(), "feature", "left_anti")
    return fresh.unionByName(_carried(kept, diff))
