"""Detected features and flows against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

NOT_SCORED = ("documentation", "shared-infra", "examples")


def recall(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """One row: share of expected names (name, aliases) that some detected name (name) equals; 0.0 if none is expected. Names meet on shared words first, so not all pairs are held against each other."""
    e = expected.select("name", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    ew = e.select("name", "alias", F.explode(N.name_tokens(F.col("alias"))).alias("word"))
    dw = detected.select(F.col("name").alias("found"), F.explode(N.name_tokens(F.col("name"))).alias("word"))
    hit = ew.join(dw, "word").where(N.same_name(F.col("found"), F.col("alias"))).select("name").distinct().withColumn("hit", F.lit(1))
    return expected.select("name").distinct().join(hit, "name", "left").agg(F.round(F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(0.0)), 6).alias("recall"))


def precision(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """One row: share of detected names, but for buckets that are not scored, that are expected."""
    scored = detected.where(~F.col("name").isin(*NOT_SCORED)).select("name").distinct()
    e = expected.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    ew = e.select("alias", F.explode(N.name_tokens(F.col("alias"))).alias("word"))
    dw = scored.select("name", F.explode(N.name_tokens(F.col("name"))).alias("word"))
    hit = dw.join(ew, "word").where(N.same_name(F.col("name"), F.col("alias"))).select("name").distinct().withColumn("hit", F.lit(1))
    return scored.join(hit, "name", "left").agg(F.round(F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(0.0)), 6).alias("precision"))


def attribution_accuracy(samples: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: samples (path, expected), how many of them are assigned (path, feature) as expected; missing files are wrong."""
    met = samples.join(assigned.select("path", "feature").distinct(), "path", "left")
    ok = F.count_if(F.lower("feature") == F.lower("expected"))
    return met.agg(F.count(F.lit(1)).alias("samples"), ok.alias("correct"), F.round(F.coalesce(F.try_divide(ok, F.count(F.lit(1))), F.lit(0.0)), 6).alias("accuracy"))


def generic_rate(detected: DataFrame, generic: tuple[str, ...]) -> DataFrame:
    """One row: share of names whose last path part, without a closing s, is generic."""
    last = F.regexp_replace(F.lower(F.substring_index("name", "/", -1)), "s$", "")
    return detected.agg(F.round(F.coalesce(F.try_divide(F.count_if(last.isin(*generic)), F.count(F.lit(1))), F.lit(0.0)), 6).alias("generic_rate"))


def flow_accuracy(flows: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: truth (name, expected_feature): `<DROP>` is right if the flow is gone, `<NEW>:x` if its owner is x or was not there before; else the owner must be the expected one. flows: (name, owner)."""
    met = truth.join(flows.select("name", "owner"), "name", "left")
    want = F.regexp_replace("expected_feature", "^<NEW>:", "")
    right = F.when(F.col("expected_feature") == "<DROP>", F.col("owner").isNull()).otherwise(F.coalesce(F.lower("owner") == F.lower(want), F.lit(False)))
    return met.agg(F.count(F.lit(1)).alias("flows"), F.count_if(right).alias("correct"), F.round(F.count_if(right) / F.count(F.lit(1)), 6).alias("accuracy"))


def ownership(flow_files: DataFrame, feature_files: DataFrame) -> DataFrame:
    """(flow, feature, files, share): how a flow's files spread over features."""
    met = flow_files.select("flow", "path").distinct().join(feature_files.select("path", "feature").distinct(), "path")
    n = met.groupBy("flow", "feature").agg(F.count(F.lit(1)).alias("files"))
    total = n.groupBy("flow").agg(F.sum("files").alias("total"))
    return n.join(total, "flow").select("flow", "feature", "files", F.round(F.col("files") / F.col("total"), 6).alias("share"))
