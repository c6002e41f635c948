"""Decisions about a feature map applied in their order: merges, then renames, splits and removals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, cut
from .rules import exact_cover

REMOVED_TO = "shared-infra"


def merged(files: DataFrame, merges: DataFrame) -> DataFrame:
    """(feature, path) with the features of a group under its largest (the first by name of equals). Groups with a feature in common are one; names that the map lacks count for nothing, nor do groups of one. merges: (ord, feature)."""
    size = files.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    known = cut(merges.join(size.select("feature"), "feature", "left_semi").select("ord", "feature").distinct())
    hub = known.groupBy("ord").agg(F.min("feature").alias("hub"))
    links = known.join(hub, "ord").where("feature <> hub").select(F.col("hub").alias("f1"), F.col("feature").alias("f2"))
    sets = components(links)
    best = sets.join(size, sets["node"] == size["feature"]).groupBy("root").agg(F.min_by("node", F.struct(-F.col("n"), "node")).alias("target"))
    to = sets.join(best, "root").select(F.col("node").alias("feature"), "target")
    return files.join(to, "feature", "left").select(F.coalesce("target", "feature").alias("feature"), "path")


def final_names(renames: DataFrame) -> DataFrame:
    """(feature, target): where a feature ends up when renames (ord, from_name, to) are carried out by ord.

    A rename takes what has its name by then, so a chain is followed only forwards in ord: of a, b and back
    to a the name is a again; a rename of a name that has gone does nothing. Chains are closed by pointer
    jumping, in rounds logarithmic in their length.
    """
    ops = cut(renames.select("ord", "from_name", "to").distinct())
    later = ops.select(F.col("ord").alias("then"), F.col("from_name").alias("to"))
    jumps = cut(ops.join(later, "to", "left").groupBy("ord", "from_name", "to").agg(F.min(F.when(F.col("then") > F.col("ord"), F.col("then"))).alias("next")))
    while not jumps.where("next is not null").isEmpty():
        far = jumps.select(F.col("ord").alias("next"), F.col("to").alias("far"), F.col("next").alias("after"))
        met = jumps.join(far, "next", "left")
        jumps = cut(met.select("ord", "from_name", F.coalesce("far", "to").alias("to"), F.col("after").alias("next")))
    return jumps.groupBy(F.col("from_name").alias("feature")).agg(F.min_by("to", "ord").alias("target"))


def operated(files: DataFrame, merges: DataFrame, renames: DataFrame, splits: DataFrame, removals: DataFrame) -> DataFrame:
    """(feature, path) after all decisions. Features that come to one name are one. A split (feature, part, path) counts if its parts cover the feature exactly; removed features (feature) go to shared-infra."""
    rows = merged(files.select("feature", "path").distinct(), merges)
    rows = cut(rows.join(final_names(renames), "feature", "left").select(F.coalesce("target", "feature").alias("feature"), "path").distinct())
    valid = exact_cover(splits, rows.join(splits.select("feature").distinct(), "feature", "left_semi")).where("valid").select("feature")
    parts = splits.join(valid, "feature", "left_semi").select("feature", "path", "part").distinct()
    rows = rows.join(parts, ["feature", "path"], "left").select(F.coalesce("part", "feature").alias("feature"), "path")
    gone = removals.select("feature", F.lit(True).alias("gone")).distinct()
    return rows.join(gone, "feature", "left").select(F.when(F.col("gone"), REMOVED_TO).otherwise(F.col("feature")).alias("feature"), "path").distinct()
