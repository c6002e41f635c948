"""Version-control text as tables: log, blame, name-status, and code owners."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import commits as C

#: One record for each commit: hash, author, ISO time, whole message; then the files.
LOG_FORMAT = "%x1e%H%x1f%an%x1f%cI%x1f%B%x1f"


def log_text(repo: str, *, most: int = 5000) -> str:
    return subprocess.run(["git", "-C", repo, "log", f"--max-count={most}", "--name-only", f"--format={LOG_FORMAT}"], capture_output=True, text=True, check=True).stdout


def parsed_log(text: DataFrame) -> DataFrame:
    """From rows of LOG_FORMAT text (column value): (sha, author, ts, message, files, is_bug_fix, pr_number)."""
    record = text.select(F.explode(F.split("value", "\u001e")).alias("r")).where("length(trim(r)) > 0")
    f = F.split("r", "\u001f")
    files = F.array_remove(F.transform(F.split(F.get(f, F.lit(4)), "\n"), lambda x: F.trim(x)), "")
    out = record.select(F.get(f, F.lit(0)).alias("sha"), F.get(f, F.lit(1)).alias("author"), F.to_timestamp(F.get(f, F.lit(2))).alias("ts"), F.regexp_replace(F.get(f, F.lit(3)), r"^\s+|\s+$", "").alias("message"), files.alias("files"))
    return out.withColumn("is_bug_fix", C.is_bug_fix(F.col("message"))).withColumn("pr_number", C.pr_number(F.col("message")))


def log(spark: SparkSession, repo: str, *, most: int = 5000) -> DataFrame:
    return parsed_log(spark.createDataFrame([(log_text(repo, most=most),)], "value string"))


def parsed_blame(text: DataFrame) -> DataFrame:
    """From (path, value) with porcelain blame text: (path, line, sha). A header holds for the lines after it."""
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    lines = text.select("path", F.posexplode(F.split("value", "\n")).alias("i", "l"))
    found = lines.where(F.col("l").rlike(head))
    return found.select("path", F.regexp_extract("l", head, 2).cast("int").alias("line"), F.regexp_extract("l", head, 1).alias("sha"))


def parsed_name_status(text: DataFrame) -> DataFrame:
    """From name-status lines (column value): (path, status). Renames and copies are the old path deleted and the new one modified."""
    parts = F.split("value", "\t")
    kind = F.substring(F.get(parts, F.lit(0)), 1, 1)
    moved = F.array(F.struct(F.get(parts, F.lit(1)).alias("path"), F.lit("deleted").alias("status")), F.struct(F.get(parts, F.lit(2)).alias("path"), F.lit("modified").alias("status")))
    one = lambda s: F.array(F.struct(F.get(parts, F.lit(1)).alias("path"), F.lit(s).alias("status")))
    rows = F.when(kind.isin("R", "C"), moved).when(kind == "A", one("added")).when(kind == "D", one("deleted")).otherwise(one("modified"))
    return text.where(F.size(parts) >= 2).select(F.inline(rows))


def code_owners(text: DataFrame) -> DataFrame:
    """From CODEOWNERS lines (column value): (team, patterns), patterns sorted and distinct; comments left out."""
    line = F.trim(F.regexp_replace("value", r"(?:^|\s)#.*$", ""))
    parts = F.split(line, r"\s+")
    each = text.where(F.length(line) > 0).select(F.get(parts, F.lit(0)).alias("pattern"), F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("team"))
    return each.where("team like '@%'").groupBy("team").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))


def packaged(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, package): files (path) by the longest package path (name, root) above them."""
    parts = F.split("path", "/")
    above = files.where(F.col("path").contains("/")).select("path", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n"))
    root = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("n")), "/").alias("root")
    met = above.select("path", "n", root).join(packages.select("root", F.col("name").alias("package")), "root")
    best = met.groupBy("path").agg(F.max_by("package", "n").alias("package"))
    return files.select("path").join(best, "path", "left")


def latest_of(scans: DataFrame, key: str = "repo", ts: str = "scanned_at") -> DataFrame:
    """The newest row of each key."""
    return scans.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(F.desc(ts)))).where("_i = 1").drop("_i")
