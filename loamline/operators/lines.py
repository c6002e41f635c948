"""Line ranges: blame, coverage and symbols within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 64


def symbol_ranges(symbols: DataFrame, last_line: Column | None = None) -> DataFrame:
    """(path, name, start, stop): a symbol ends before the next one, the last at `last_line`; the first of equal names counts."""
    first = symbols.groupBy("path", "name").agg(F.min("start").alias("start"))
    nxt = F.lead("start").over(W.partitionBy("path").orderBy("start", "name")) - 1
    return first.select("path", "name", "start", F.greatest("start", F.coalesce(nxt, last_line if last_line is not None else F.lit(50))).alias("stop"))


def within(points: DataFrame, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """Points (path, line, ...) joined to ranges (path, start, stop, ...) around them.

    Both are keyed by path and block of BLOCK lines, so that a long file is no single task's and a range
    meets only the blocks that it covers.
    """
    p = points.withColumn("block", F.expr(f"line div {BLOCK}"))
    r = ranges.withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"stop div {BLOCK}"))))
    met = r.join(p, ["path", "block"], how)
    return met.where("line between start and stop").drop("block")


def merged_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, stop): overlapping and adjacent ranges as one."""
    w = W.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0)
    marked = ranges.withColumn("fresh", fresh)
    island = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, line, name): the smallest symbol around each line."""
    met = within(points.select("path", "line").distinct(), ranges)
    return met.groupBy("path", "line").agg(F.min_by("name", F.struct((F.col("stop") - F.col("start")).alias("n"), "start", "name")).alias("name"))


def range_coverage(ranges: DataFrame, coverage: DataFrame) -> DataFrame:
    """ranges with `pct`: share of instrumented lines that are hit, rounded to one place; null if no line is instrumented."""
    got = within(coverage, ranges).groupBy("path", "name", "start", "stop").agg(F.round(F.count_if(F.col("hits") > 0) * 100.0 / F.count(F.lit(1)), 1).alias("pct"))
    return ranges.join(got, ["path", "name", "start", "stop"], "left")


def range_commits(ranges: DataFrame, blame: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sha): commits that last touched a line within the ranges, each once."""
    return within(blame, ranges).select(*keys, "sha").distinct()
