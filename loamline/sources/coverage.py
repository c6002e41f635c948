"""Coverage reports of several formats as (path, line, hits)."""

from __future__ import annotations

import sqlite3
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut, sized

_LINES = "path string, line int, hits int"


def _raw(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.text(location, wholetext=True).withColumn("file", F.input_file_name())


def _highest(found: DataFrame, keys: list[str]) -> DataFrame:
    """A line counts with its highest hits."""
    return found.groupBy(*keys, "path", "line").agg(F.max("hits").alias("hits"))


def lcov_lines(raw: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, line, hits) from LCOV texts (keys, value), any number for each key; malformed DA lines are skipped."""
    text = raw.select(*keys, F.split("value", "(?:^|\n)SF:").alias("parts"))
    lines = text.select(*keys, F.explode(F.slice("parts", F.lit(2), F.size("parts"))).alias("part")).select(*keys, F.split("part", "\r?\n").alias("ls"))
    own = lines.select(*keys, F.trim(F.get("ls", F.lit(0))).alias("path"), F.explode(F.slice("ls", F.lit(2), F.size("ls"))).alias("l"))
    da = r"^DA:(\d+),(\d+)"
    return _highest(own.where(F.col("l").rlike(da)).select(*keys, "path", F.regexp_extract("l", da, 1).cast("int").alias("line"), F.regexp_extract("l", da, 2).cast("int").alias("hits")), keys)


def json_lines(raw: DataFrame, keys: list[str]) -> DataFrame:
    """The same from JSON of coverage.py: executed and missing lines of each file."""
    shape = "files map<string, struct<executed_lines: array<int>, missing_lines: array<int>>>"
    files = raw.select(*keys, F.explode(F.from_json("value", shape)["files"]).alias("path", "f"))
    each = lambda c, hits: files.select(*keys, "path", F.explode(f"f.{c}").alias("line"), F.lit(hits).alias("hits"))
    return _highest(each("executed_lines", 1).unionByName(each("missing_lines", 0)), keys)


def jest_lines(raw: DataFrame, keys: list[str]) -> DataFrame:
    """The same from JSON of Jest: statements by id, each at its start line."""
    shape = "map<string, struct<path: string, statementMap: map<string, struct<start: struct<line: int>>>, s: map<string, int>>>"
    files = raw.select(*keys, F.explode(F.from_json("value", shape)).alias("k", "f"))
    st = files.select(*keys, F.coalesce("f.path", "k").alias("path"), F.explode("f.statementMap").alias("id", "at"), F.col("f.s").alias("s"))
    return _highest(st.select(*keys, "path", F.col("at.start.line").alias("line"), F.coalesce(F.try_element_at("s", "id"), F.lit(0)).alias("hits")).where("line is not null"), keys)


def cobertura_lines(raw: DataFrame, keys: list[str]) -> DataFrame:
    """The same from Cobertura XML."""
    shape = "packages struct<package: array<struct<classes: struct<class: array<struct<_filename: string, lines: struct<line: array<struct<_number: int, _hits: int>>>>>>>>>"
    classes = raw.select(*keys, F.explode(F.flatten(F.from_xml("value", shape)["packages"]["package"]["classes"]["class"])).alias("c"))
    each = classes.select(*keys, F.col("c._filename").alias("path"), F.explode("c.lines.line").alias("l"))
    return _highest(each.select(*keys, "path", F.col("l._number").alias("line"), F.col("l._hits").alias("hits")), keys)


def lcov(spark: SparkSession, location: str) -> DataFrame:
    """(path, line, hits) of LCOV files."""
    return _highest(lcov_lines(_raw(spark, location), ["file"]), [])


def coverage_json(spark: SparkSession, location: str) -> DataFrame:
    return json_lines(_raw(spark, location), [])


def jest_final(spark: SparkSession, location: str) -> DataFrame:
    return jest_lines(_raw(spark, location), [])


def cobertura(spark: SparkSession, location: str) -> DataFrame:
    """Cobertura XML, read class by class, so that a large report is many rows."""
    shape = "_filename string, lines struct<line: array<struct<_number: int, _hits: int>>>"
    classes = spark.read.format("xml").option("rowTag", "class").schema(shape).load(location)
    each = classes.select(F.col("_filename").alias("path"), F.explode("lines.line").alias("l"))
    return _highest(each.select("path", F.col("l._number").alias("line"), F.col("l._hits").alias("hits")), [])


#: Where reports are looked for in a repository, in this order, and how they are read.
CANDIDATES = (
    ("coverage.json", json_lines), ("coverage/coverage-final.json", jest_lines), ("coverage.xml", cobertura_lines), ("coverage/cobertura-coverage.xml", cobertura_lines),
    ("coverage/lcov.info", lcov_lines), ("lcov.info", lcov_lines), ("coverage.lcov", lcov_lines),
)


def detected(reports: DataFrame) -> DataFrame:
    """(repo, path, line, hits) of the first report of each repository that holds any line. reports: (repo, name, value), name below the repository's top. (The SQLite form is binary: coverage_sqlite.)

    A report may come in several texts of one name, as shards of a run write them. A text is one row, read by one task.
    """
    reports = cut(reports.where(F.col("name").isin([n for n, _ in CANDIDATES])).select("repo", "name", "value"))
    rank = F.coalesce(*[F.when(F.col("name") == n, i) for i, (n, _) in enumerate(CANDIDATES)])
    held = [read(reports.where(F.col("name") == name), ["repo", "name"]).select("repo", "name") for name, read in CANDIDATES]
    first = sized(reduce(DataFrame.unionByName, held).groupBy("repo").agg(F.min_by("name", rank).alias("name")))
    return reduce(DataFrame.unionByName, [read(reports.where(F.col("name") == name).join(first, ["repo", "name"], "left_semi"), ["repo"]) for name, read in CANDIDATES])


def numbits(blob: Column) -> Column:
    """Line numbers of a bitmap: bit b of byte a, from the least, stands for line 8a + b + 1."""
    digits = F.hex(blob)
    n = (F.length(digits) / 2).cast("int")
    byte = lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    bits = F.transform(F.sequence(F.lit(0), n * 8 - 1), lambda k: F.when(F.getbit(byte((k / 8).cast("int")), (k % 8).cast("int")) == 1, k + 1))
    return F.when(n > 0, F.array_compact(bits)).otherwise(F.array().cast("array<int>"))


def coverage_sqlite(spark: SparkSession, file: str) -> DataFrame:
    """The .coverage database of coverage.py: one file on the driver, its bitmaps decoded in the engine."""
    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as con:
        rows = con.execute("SELECT f.path, b.numbits FROM line_bits b JOIN file f ON f.id = b.file_id").fetchall()
    blobs = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, b binary")
    return blobs.select("path", F.explode(numbits(F.col("b"))).alias("line")).distinct().withColumn("hits", F.lit(1))


def file_coverage(lines: DataFrame, keys: list[str] | tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, pct): share of instrumented lines that are hit, to one place."""
    return lines.groupBy(*keys).agg(F.round(F.count_if(F.col("hits") > 0) * 100.0 / F.count(F.lit(1)), 1).alias("pct"))


def matched(coverage: DataFrame, files: DataFrame) -> DataFrame:
    """coverage with `path` as in `files`: equal, else the shortest file path that ends with the reported one or that it ends with. Suffixes are keyed whole segment by segment, so nothing is held against every file."""
    tails = lambda df, c: df.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))).alias("tail"))
    reported = coverage.select(F.col("path").alias("given")).distinct()
    known = files.select(F.col("path").alias("own")).distinct()
    a = tails(known, "own").join(reported, F.col("tail") == F.col("given")).select("given", "own")
    b = tails(reported, "given").join(known, F.col("tail") == F.col("own")).select("given", "own")
    best = a.unionByName(b).groupBy("given").agg(F.min_by("own", F.struct((F.col("own") != F.col("given")).alias("off"), F.length("own"), "own")).alias("own"))
    return coverage.join(best, coverage["path"] == best["given"]).select(F.col("own").alias("path"), *[c for c in coverage.columns if c != "path"])
