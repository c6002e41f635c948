"""Caches and decisions carried out in order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import caches as C
from ..operators import operations as O
from ..operators.graph import shared_folder
from ..sources import bridge as B
from .registry import query

CACHE = "ca AS (SELECT o_custkey AS key, 'name' || o_orderkey AS value, o_orderdate AS written, o_orderkey FROM orders WHERE o_orderkey % 3 > 0), la AS (SELECT key, max_by(value, (written, value)) AS value, max(written) AS written FROM ca GROUP BY 1), ck AS (SELECT TIMESTAMP '2001-10-01 00:00:00' AS as_of), lk AS (SELECT c_custkey AS key, CASE WHEN written IS NULL THEN 'missing' WHEN floor((epoch(as_of) - epoch(written)) / 86400) > 90 THEN 'expired' ELSE 'hit' END AS status, value, as_of FROM customer LEFT JOIN la ON key = c_custkey, ck)"


def cached(spark, d):
    """Orders stand for answers about customers; two thirds of them are kept."""
    o = B.table(spark, d, "orders").where("o_orderkey % 3 > 0")
    cache = o.select(F.col("o_custkey").alias("key"), F.concat(F.lit("name"), F.col("o_orderkey").cast("string")).alias("value"), F.col("o_orderdate").alias("written"))
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("key")), cache, spark.sql("select timestamp_ntz'2001-10-01 00:00:00' as as_of")


@query("sk4_cached_names", f"WITH {CACHE} SELECT key, status, CASE WHEN status = 'hit' THEN value ELSE 'new' || key END AS value FROM lk")
def sk4(spark, d):
    """Hits, expired and missing keys; what isn't a hit is asked for."""
    wanted, cache, now = cached(spark, d)
    return C.answered(wanted, cache, now, lambda k: k.withColumn("value", F.concat(F.lit("new"), F.col("key").cast("string"))))[0]


@query("sk4_cache_after", f"WITH {CACHE} SELECT key, value, written FROM ca, ck WHERE floor((epoch(as_of) - epoch(written)) / 86400) <= 90 AND key NOT IN (SELECT key FROM lk WHERE status <> 'hit') UNION ALL SELECT key, 'new' || key, as_of FROM lk WHERE status <> 'hit'")
def sk4_after(spark, d):
    wanted, cache, now = cached(spark, d)
    return C.answered(wanted, cache, now, lambda k: k.withColumn("value", F.concat(F.lit("new"), F.col("key").cast("string"))))[1]


@query("sc5_blame_cache", "WITH f AS (SELECT path, part, part % 5 = 0 AS again FROM files WHERE part % 11 <> 4) SELECT path, count(line) AS lines, sum(sha + CASE WHEN again THEN 1 ELSE 0 END)::BIGINT AS shas, again FROM f LEFT JOIN blame_lines USING (path) WHERE line IS NOT NULL OR part % 13 = 0 GROUP BY path, again, part HAVING count(line) > 0", "blame_lines")
def sc5_cache(spark, d):
    """Two runs over one cache: all files, then those of every fifth part with a new head (their lines read anew, with shas one higher) while every eleventh is gone. `again` tells what the second run read."""
    folder = f"{shared_folder(spark)}/blame-{uuid.uuid4().hex}"
    lines, f = B.blame_lines(spark, d), B.files(spark, d).select("path", "part")
    told = lambda more: lambda todo: lines.join(todo.select("path"), "path").select("path", "line", (F.col("sha") + more).cast("string").alias("sha"))
    C.refreshed_blame(spark, folder, f.select("path", F.lit("h0").alias("head")), told(0), slots=16)
    heads = f.where("part % 11 <> 4").select("path", F.when(F.col("part") % 5 == 0, "h1").otherwise("h0").alias("head"))
    after = C.refreshed_blame(spark, folder, heads, told(1), slots=16)
    return after.where("line is not null").groupBy("path", "head").agg(F.count("line").alias("lines"), F.sum(F.col("sha").cast("long")).alias("shas")).select("path", "lines", "shas", (F.col("head") == "h1").alias("again"))


OPS_SQL = """m AS (SELECT CASE WHEN feature IN ('brand11', 'brand12', 'brand13') THEN 'm1' WHEN feature IN ('brand21', 'brand22') THEN 'm2' ELSE feature END AS g, feature, path, flow FROM files),
z AS (SELECT g, feature, count(*) AS n FROM m GROUP BY 1, 2), t AS (SELECT g, min_by(feature, (-n, feature)) AS target FROM z GROUP BY 1),
r AS (SELECT CASE target WHEN 'brand31' THEN 'f' WHEN 'brand32' THEN 'brand32' WHEN 'brand33' THEN 'brand34x' WHEN 'brand51' THEN 'one' WHEN 'brand52' THEN 'one' ELSE target END AS feature, path, flow FROM m JOIN t USING (g)),
s AS (SELECT CASE WHEN feature = 'brand41' THEN flow ELSE feature END AS feature, path FROM r)"""


@query("ops_in_order", f"WITH {OPS_SQL} SELECT CASE WHEN feature IN ('brand43', 'f') THEN 'shared-infra' ELSE feature END AS feature, count(*) AS files FROM s GROUP BY 1", "files")
def operations(spark, d):
    """Overlapping merges, a chain of five renames, a cycle, a rename that comes too late, two to one name, a split that holds and one that leaves files over, removals."""
    f = B.files(spark, d)
    merges = spark.createDataFrame([(1, "brand11"), (1, "brand12"), (2, "brand12"), (2, "brand13"), (3, "brand21"), (3, "brand22"), (4, "brand23"), (4, "nobody")], "ord int, feature string")
    renames = spark.createDataFrame([(1, "brand31", "b"), (2, "b", "c"), (3, "c", "d"), (4, "d", "e"), (5, "e", "f"), (6, "brand32", "x"), (7, "x", "brand32"), (8, "y", "z"), (9, "brand33", "brand34x"), (3, "brand34x", "late"), (10, "brand51", "one"), (11, "brand52", "one")], "ord int, from_name string, to string")
    splits = f.where("feature = 'brand41' or feature = 'brand42' and part % 3 > 0").select("feature", F.col("flow").alias("part"), "path")
    return O.operated(f, merges, renames, splits, spark.createDataFrame([("brand43",), ("f",), ("nobody",)], "feature string")).groupBy("feature").agg(F.count(F.lit(1)).alias("files"))
