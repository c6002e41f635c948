"""What reports and tools say of a map: summaries, hotspots with files, owners at risk, rows of the two-level table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P


def repo_summary(features: DataFrame, flows: DataFrame, coverage: DataFrame, *, at_risk: float = 50) -> DataFrame:
    """One row: features, flows, bug_fixes, mean_health, mean_coverage of features that have one (else null), and how many features are below `at_risk`. features: (feature, bug_fixes, health); flows: (feature, flow); coverage: (feature, pct)."""
    f = features.agg(F.count(F.lit(1)).alias("features"), F.coalesce(F.sum("bug_fixes"), F.lit(0)).alias("bug_fixes"), F.round(F.coalesce(F.avg("health"), F.lit(0.0)), 1).alias("mean_health"), F.count_if(F.col("health") < at_risk).alias("at_risk"))
    n = flows.select("feature", "flow").distinct().agg(F.count(F.lit(1)).alias("flows"))
    c = coverage.agg(F.round(F.avg("pct"), 1).alias("mean_coverage"))
    return f.join(F.broadcast(n), how="cross").join(F.broadcast(c), how="cross").select("features", "flows", "bug_fixes", "mean_health", "mean_coverage", "at_risk")  # one row each


def hotspot_features(features: DataFrame, hot_files: DataFrame, *, most: int = 10, files: int = 3, owners: int = 3) -> DataFrame:
    """(feature, health, bug_fixes, hotspot_files, owners): the `most` unhealthiest features with their first hot files (flows by name, then by place) and owners. features: (feature, health, bug_fixes, authors joined by |); hot_files: (feature, flow, path, place)."""
    top = features.orderBy("health", "feature").limit(most)
    place = F.row_number().over(W.partitionBy("feature").orderBy("flow", "place"))
    hot = hot_files.withColumn("i", place).where(F.col("i") <= files).groupBy("feature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "path"))), lambda x: x["path"]), "|").alias("hotspot_files"))
    return top.join(hot, "feature", "left").select("feature", "health", "bug_fixes", F.coalesce("hotspot_files", F.lit("")).alias("hotspot_files"), F.array_join(F.slice(F.split("authors", r"\|"), 1, owners), "|").alias("owners"))


def owners(features: DataFrame, flow_bus: DataFrame) -> DataFrame:
    """(feature, contributors, bus_factor, at_risk): the smallest bus factor of a feature's flows, without flows its number of authors (one at least); at risk with one. features: (feature, authors joined by |); flow_bus: (feature, bus_factor)."""
    least = flow_bus.groupBy("feature").agg(F.min("bus_factor").alias("least"))
    n = F.size(F.array_remove(F.split("authors", r"\|"), ""))
    bus = F.coalesce("least", F.greatest(n, F.lit(1)))
    return features.join(least, "feature", "left").select("feature", n.cast("long").alias("contributors"), bus.cast("long").alias("bus_factor"), (bus == 1).alias("at_risk"))


def centrality(entries: DataFrame, feature_files: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, feature, centrality): the share of a feature's files that import a flow's entry; features without any have no row. entries: (flow, path); edges: (src, dst)."""
    size = feature_files.groupBy("feature").agg(F.countDistinct("path").alias("size"))
    use = entries.join(edges.select("src", F.col("dst").alias("path")).distinct(), "path").join(feature_files.select("feature", F.col("path").alias("src")).distinct(), "src")
    n = use.groupBy("flow", "feature").agg(F.countDistinct("src").alias("n"))
    return n.join(size, "feature").select("flow", "feature", F.round(F.col("n") / F.col("size"), 6).alias("centrality"))


def test_files(flow_files: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(flow, own, adjacent): test files among a flow's own, and those touched by commits that change a test in one of the flow's directories. A file may be both. flow_files: (flow, path); commit_files: (sha, path)."""
    own = flow_files.select("flow", "path").distinct()
    tests = commit_files.where(P.is_test_path_regex(F.col("path"))).distinct()
    dirs = own.select("flow", P.parent(F.col("path")).alias("dir")).distinct()
    near = tests.select("sha", P.parent(F.col("path")).alias("dir")).distinct().join(dirs, "dir").select("flow", "sha").distinct()
    more = near.join(tests, "sha").groupBy("flow").agg(F.countDistinct("path").alias("adjacent"))
    n = own.groupBy("flow").agg(F.count_if(P.is_test_path_regex(F.col("path"))).alias("own"))
    return n.join(more, "flow", "left").select("flow", "own", F.coalesce("adjacent", F.lit(0)).alias("adjacent"))


test_files.__test__ = False


def _counts() -> Column:
    return F.concat(F.lit("health "), F.round("health").cast("long").cast("string"), F.lit(", "), F.col("total_commits").cast("string"), F.lit(" commits, "), F.col("bug_fixes").cast("string"), F.lit(" fixes"))


def two_level_rows(features: DataFrame, flows: DataFrame) -> DataFrame:
    """(feature, place, row): the report's rows of each feature in order: the feature first, its flows below by falling share of fixes, the last marked. features: (feature, health, total_commits, bug_fixes, bug_fix_ratio); flows: the same with flow."""
    w = W.partitionBy("feature").orderBy(F.desc("bug_fix_ratio"), "flow")
    last = F.lead("flow").over(w).isNull()
    nested = flows.select("feature", F.row_number().over(w).alias("place"), F.concat(F.when(last, "└─ ").otherwise("├─ "), "flow", F.lit(": "), _counts()).alias("row"))
    return features.select("feature", F.lit(0).alias("place"), F.concat("feature", F.lit(": "), _counts()).alias("row")).unionByName(nested)


def top_risks(features: DataFrame, most: int = 3) -> DataFrame:
    """(place, row): the features with most fixes for their commits, none without a fix."""
    top = features.where("bug_fixes > 0").orderBy(F.desc("bug_fix_ratio"), "feature").limit(most)
    place = F.row_number().over(W.orderBy(F.desc("bug_fix_ratio"), "feature"))  # `most` rows
    row = F.concat("feature", F.lit(": "), F.col("bug_fixes").cast("string"), F.lit(" bug fixes out of "), F.col("total_commits").cast("string"), F.lit(" commits"))
    return top.select(place.alias("place"), row.alias("row"))


def digest_by_directory(touched: DataFrame, commits: DataFrame) -> DataFrame:
    """(dir, commits, fixes, touches): per first directory of the files touched; files at the top are in `.`."""
    own = touched.select("sha", F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".").alias("dir")).join(commits.select("sha", "is_bug_fix"), "sha")
    once = own.groupBy("dir", "sha", "is_bug_fix").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("dir").agg(F.count(F.lit(1)).alias("commits"), F.count_if("is_bug_fix").alias("fixes"), F.sum("n").alias("touches"))


def affected_flows(flow_files: DataFrame, change: DataFrame) -> DataFrame:
    """(feature, flow, touched): flows with files in the change, each file once."""
    return flow_files.select("feature", "flow", "path").distinct().join(change.select("path").distinct(), "path", "left_semi").groupBy("feature", "flow").agg(F.count(F.lit(1)).alias("touched"))
