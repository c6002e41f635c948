"""Feature maps and tables written out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def feature_document(features: DataFrame, feature_files: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """(feature, body): one JSON document for each feature with its metrics, its sorted paths and its flows (feature, flow). A map of a large history is many documents, never one row."""
    paths = feature_files.groupBy("feature").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    out = features.join(paths, "feature", "left")
    if flows is not None:
        out = out.join(flows.groupBy("feature").agg(F.array_sort(F.collect_set("flow")).alias("flows")), "feature", "left")
    return out.select("feature", F.to_json(F.struct(*out.columns)).alias("body"))


def map_name(repo: str, stamp: str) -> str:
    """File name of a map: slug of the repository and a time stamp."""
    return f"feature-map-{re.sub(r'[^a-z0-9]+', '-', repo.lower()).strip('-')}-{stamp}"


def write_map(documents: DataFrame, folder: str, repo: str, stamp: str) -> str:
    path = f"{folder}/{map_name(repo, stamp)}"
    documents.select("body").write.mode("overwrite").text(path)
    return path


def latest_map(spark: SparkSession, folder: str, repo: str, schema: str) -> DataFrame:
    """The newest map of a repository, by its time stamp."""
    files = spark.read.text(f"{folder}/{map_name(repo, '*')}").select("value", F.input_file_name().alias("file"))
    newest = files.agg(F.max(F.regexp_replace("file", r"/[^/]*$", "")).alias("dir"))
    own = files.join(F.broadcast(newest), F.regexp_replace("file", r"/[^/]*$", "") == F.col("dir"))  # one row
    return own.select(F.from_json("value", schema).alias("d")).select("d.*")


def upsert_blame(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blame lines (path, line, sha) with all lines of the files in `new` replaced by those in `new`."""
    return old.join(new.select("path").distinct(), "path", "left_anti").unionByName(new)


def assignments(old: DataFrame, now: DataFrame) -> DataFrame:
    """The file -> name cache (path, name, seen): the newest entry of each path."""
    both = old.unionByName(now)
    return both.withColumn("i", F.row_number().over(W.partitionBy("path").orderBy(F.desc("seen"), "name"))).where("i = 1").drop("i")


def locked_names(feature_files: DataFrame, least: int = 10) -> DataFrame:
    """Features with at least `least` files, whose names are kept from now on."""
    return feature_files.groupBy("feature").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") >= least)


def report_lines(features: DataFrame, *, at_risk: float = 50, watch: float = 77) -> DataFrame:
    """(place, line): the report's row of each feature, the riskiest first. features: (feature, files, total_commits, bug_fixes, bug_fix_ratio, health)."""
    note = F.when(F.col("health") < at_risk, " (at risk)").when(F.col("health") < watch, " (watch)").otherwise("")
    line = F.concat("feature", F.lit(": "), F.col("files").cast("string"), F.lit(" files, "), F.col("total_commits").cast("string"), F.lit(" commits, "), F.col("bug_fixes").cast("string"), F.lit(" fixes, health "), F.round("health").cast("long").cast("string"), note)
    place = F.row_number().over(W.orderBy(F.desc("bug_fix_ratio"), "feature"))  # one row for each feature
    return features.select(place.alias("place"), line.alias("line"))
