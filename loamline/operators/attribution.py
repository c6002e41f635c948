"""Commits to features, and what is counted of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scores as S
from .graph import cut


def assigned(commit_files: DataFrame, feature_files: DataFrame) -> DataFrame:
    """(sha, path, feature): by the file's own feature (the last that lists it), else by the first feature with a file in the same directory. `feature_files` is (feature, path); features are ordered by name."""
    own = feature_files.groupBy("path").agg(F.max("feature").alias("own"))
    near = feature_files.select("feature", P.parent(F.col("path")).alias("dir")).where("dir <> '.'").groupBy("dir").agg(F.min("feature").alias("near"))
    met = commit_files.withColumn("dir", P.parent(F.col("path"))).join(own, "path", "left").join(near, "dir", "left")
    return met.select("sha", "path", F.coalesce("own", "near").alias("feature")).where("feature is not null")


def weighted_ratio(bug: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(F.when(bug, weight).otherwise(F.lit(0.0))), F.sum(weight))


def metrics(features: DataFrame, touched: DataFrame, commits: DataFrame, as_of: DataFrame, key: str = "feature") -> DataFrame:
    """One row for each of `features` (column key): total_commits, bug_fixes, bug_fix_ratio, authors, last_modified, health.

    touched: (sha, key), a commit counts once for each key. Features without commits stay: ratio 0, health 100.
    """
    once = touched.select("sha", key).distinct().join(commits.select("sha", "author", "ts", "is_bug_fix"), "sha").crossJoin(F.broadcast(as_of))
    w = S.age_weight(S.age_days(F.col("ts"), F.col("as_of")))
    got = once.withColumn("w", w).groupBy(key).agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.count_if("is_bug_fix").alias("bug_fixes"),
        F.array_join(F.array_sort(F.collect_set("author")), "|").alias("authors"),
        F.max("ts").alias("last_modified"),
        weighted_ratio(F.col("is_bug_fix"), F.col("w")).alias("x"),
    )
    out = features.select(key).distinct().join(got, key, "left")
    n = F.coalesce("total_commits", F.lit(0))
    return out.select(
        key, n.alias("total_commits"), F.coalesce("bug_fixes", F.lit(0)).alias("bug_fixes"), F.coalesce(F.round(F.try_divide("bug_fixes", "total_commits"), 3), F.lit(0.0)).alias("bug_fix_ratio"),
        F.coalesce("authors", F.lit("")).alias("authors"), "last_modified", F.round(S.health(F.col("x"), F.col("total_commits")), 6).alias("health"),
    )


def bus_factor(touched: DataFrame, commits: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """(key, bus_factor): authors with at least `share` of the commits, one at least."""
    per = touched.select("sha", key).distinct().join(commits.select("sha", "author"), "sha").groupBy(key, "author").count()
    total = per.groupBy(key).agg(F.sum("count").alias("total"))
    big = F.count_if(F.col("count") >= F.greatest(F.lit(1.0), F.col("total") * share))
    return per.join(total, key).groupBy(key).agg(F.greatest(F.lit(1), big).alias("bus_factor"))


def week_label(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def weekly(touched: DataFrame, commits: DataFrame, key: str) -> DataFrame:
    """(key, week, total, bug) by ISO week; weeks without commits have no row."""
    once = touched.select("sha", key).distinct().join(commits.select("sha", "ts", "is_bug_fix"), "sha")
    return once.groupBy(key, week_label(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_bug_fix").alias("bug"))


def health_trend(points: DataFrame, key: str, least: int = 4) -> DataFrame:
    """(key, trend): bug ratio of the first half of the weekly points minus that of the rest; null below `least` points."""
    by = W.partitionBy(key)
    halves = points.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("first", F.row_number().over(by.orderBy("week")) <= F.floor(F.col("n") / 2))

    def ratio(side: Column) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.when(side, F.col("bug"))), F.sum(F.when(side, F.col("total")))), F.lit(0.0))

    trend = F.when(F.first("n") >= least, F.round(ratio(F.col("first")) - ratio(~F.col("first")), 3))
    return halves.groupBy(key).agg(trend.alias("trend"))


def hotspots(touched: DataFrame, commits: DataFrame, key: str, *, least: int = 3, share: float = 0.4, most: int = 5) -> DataFrame:
    """(key, path, commits, bug_share, place): files with enough commits of which more than `share` are fixes; tests left out."""
    files = touched.where(~P.is_test_path_regex(F.col("path"))).join(commits.select("sha", "is_bug_fix"), "sha").groupBy(key, "path").agg(F.countDistinct("sha").alias("commits"), F.countDistinct(F.when(F.col("is_bug_fix"), F.col("sha"))).alias("bugs"))
    hot = files.withColumn("bug_share", F.col("bugs") / F.col("commits")).where((F.col("commits") >= least) & (F.col("bug_share") > share))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("bug_share"), "path"))
    return hot.withColumn("place", place).where(F.col("place") <= most).select(key, "path", "commits", F.round("bug_share", 6).alias("bug_share"), "place")


def bug_fix_prs(touched: DataFrame, commits: DataFrame, key: str) -> DataFrame:
    """(key, pr_number, sha, title): the newest bug-fix commit of each pull request."""
    own = touched.select("sha", key).distinct().join(commits.where("is_bug_fix and pr_number is not null"), "sha")
    first = F.row_number().over(W.partitionBy(key, "pr_number").orderBy(F.desc("ts"), F.desc("sha")))
    return own.withColumn("i", first).where("i = 1").select(key, "pr_number", "sha", F.left(F.substring_index("message", "\n", 1), F.lit(120)).alias("title"))


def flow_details(files: DataFrame, commit_files: DataFrame, commits: DataFrame, ranges: DataFrame) -> DataFrame:
    """(flow, trend, hotspots, prs, coverage) for each flow with commits: the trend of its weeks, its hottest files in order, its pull requests that fix bugs, and the mean coverage of its ranges outside of tests.

    files: (flow, path); ranges: (path, .., pct).
    """
    t = cut(commit_files.join(files.select("path", "flow"), "path").select("sha", "path", "flow"))
    trend = health_trend(weekly(t, commits, "flow"), "flow")
    hot = hotspots(t, commits, "flow").groupBy("flow").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), "|").alias("hotspots"))
    prs = bug_fix_prs(t, commits, "flow").groupBy("flow").agg(F.count(F.lit(1)).alias("prs"))
    covered = ranges.where(~P.is_test_path_regex(F.col("path"))).join(files.select("path", "flow"), "path").groupBy("flow").agg(F.avg("pct").alias("coverage"))
    met = trend.join(hot, "flow", "left").join(prs, "flow", "left").join(covered, "flow", "left")
    return met.select("flow", "trend", F.coalesce("hotspots", F.lit("")).alias("hotspots"), F.coalesce("prs", F.lit(0)).alias("prs"), "coverage")


def merge_small(feature_files: DataFrame, least: int = 3, gate: int = 15) -> DataFrame:
    """(feature, target): features with fewer than `least` files and the one that absorbs them: the owner of the nearest directory above (most files, then the shortest name). Where there are no more than `gate` features, all stay."""
    sizes = feature_files.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("path", "/")
    depth = F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))))
    dirs = feature_files.where(F.col("path").contains("/")).select("feature", "path", depth.alias("depth")).select("feature", "depth", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/").alias("dir")).distinct()
    many = sizes.agg((F.count(F.lit(1)) > gate).alias("many"))  # one row
    sizes = sizes.join(F.broadcast(many), F.col("many"), "left_semi") if gate else sizes
    big = sizes.where(F.col("n") >= least)
    owner = dirs.join(big, "feature").select(F.col("feature").alias("target"), "dir", "depth", F.col("n").alias("size"))
    small = dirs.join(sizes.where(F.col("n") < least), "feature").select("feature", "dir")
    best = F.max_by("target", F.struct("depth", "size", -F.length("target"), "target"))
    return small.join(owner, "dir").groupBy("feature").agg(best.alias("target"))


def walked(commits: DataFrame, clock: DataFrame, order: list[str | Column], *, days: int = 365, most: int = 5000) -> DataFrame:
    """Commits in the order of the walk (from the largest of `order` down) up to the first that is older than `days` (it and all behind it are left out), `most` of them. clock: one row with as_of.

    Where the walk stops is found by one aggregation over the order's columns; only the `most` commits before it are sorted.
    """
    key = F.struct(*order)
    c = commits.join(F.broadcast(clock), how="cross").withColumn("walk", key).withColumn("young", F.col("ts") >= F.col("as_of") - F.make_dt_interval(days=F.lit(days)))
    stop = c.agg(F.max(F.when(~F.col("young"), F.col("walk"))).alias("stop"))  # one row
    before = c.join(F.broadcast(stop), how="cross").where(F.col("stop").isNull() | (F.col("walk") > F.col("stop")))
    return before.orderBy(F.desc("walk")).limit(most).drop("walk", "young", "as_of", "stop")


def freshness(scans: DataFrame, touches: DataFrame, commits: DataFrame, known: DataFrame, clock: DataFrame) -> DataFrame:
    """(repo, stale, behind, changed, has_new, days): what has happened since each repository's scan: commits and files after it, whether any is new to the map, whole days.

    scans: (repo, scanned, head); touches: (repo, sha, path), shas in order of time; commits: (sha, ts); known: (path); clock: one row with as_of.
    """
    after = touches.join(scans.select("repo", "scanned"), "repo").where("sha > scanned").join(known.select("path", F.lit(True).alias("known")).distinct(), "path", "left")
    n = after.groupBy("repo").agg(F.countDistinct("sha").alias("behind"), F.countDistinct("path").alias("changed"), F.max(F.col("known").isNull()).alias("has_new"))
    met = scans.join(commits.select(F.col("sha").alias("scanned"), "ts"), "scanned").join(F.broadcast(clock), how="cross").join(n, "repo", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    days = F.greatest(F.lit(0), S.age_days(F.col("ts"), F.col("as_of")))
    return met.select("repo", (F.col("scanned") != F.col("head")).alias("stale"), zero("behind").alias("behind"), zero("changed").alias("changed"), F.coalesce("has_new", F.lit(False)).alias("has_new"), days.cast("long").alias("days"))
