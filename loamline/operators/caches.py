"""Answers kept between runs: look-ups with an age limit, and blame that is read again only for files that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut

#: Days for which a name stays good.
NAME_DAYS = 90
#: Partitions of the blame cache.
SLOTS = 256


def _age(written: Column, as_of: Column) -> Column:
    """Whole days."""
    return F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(written.cast("timestamp"))) / 86_400_000_000)


def looked_up(wanted: DataFrame, cache: DataFrame, as_of: DataFrame, *, days: int = NAME_DAYS) -> DataFrame:
    """(key, value, status) of each wanted key: `hit` with its value, `expired` if it was written more than `days` days ago, or `missing`.

    wanted: (key); cache: (key, value, written), of equal keys the latest counts; as_of: one row.
    """
    last = cache.groupBy("key").agg(F.max_by(F.struct("value", "written"), F.struct("written", "value")).alias("c")).select("key", "c.value", "c.written")
    met = wanted.select("key").distinct().join(last, "key", "left").join(F.broadcast(as_of), how="cross")
    status = F.when(F.col("written").isNull(), "missing").when(_age(F.col("written"), F.col("as_of")) > days, "expired").otherwise("hit")
    return met.select("key", F.when(status == "hit", F.col("value")).alias("value"), status.alias("status"))


def answered(wanted: DataFrame, cache: DataFrame, as_of: DataFrame, ask: Callable[[DataFrame], DataFrame], *, days: int = NAME_DAYS) -> tuple[DataFrame, DataFrame]:
    """(key, value, status) of the wanted keys, and the cache after: only what isn't a hit goes to `ask` (from (key) to (key, value)); its answers are written as of now, and entries too old to be used go."""
    found = cut(looked_up(wanted, cache, as_of, days=days))
    new = cut(ask(found.where("status <> 'hit'").select("key")).select("key", "value"))
    values = found.where("status = 'hit'").unionByName(found.where("status <> 'hit'").drop("value").join(new, "key", "left").select("key", "value", "status"))
    kept = cache.join(new.select("key"), "key", "left_anti").join(F.broadcast(as_of), how="cross").where(_age(F.col("written"), F.col("as_of")) <= days)
    after = kept.select("key", "value", "written").unionByName(new.join(F.broadcast(as_of), how="cross").select("key", "value", F.col("as_of").alias("written")))
    return values, after


def changed_heads(heads: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, head) of files that the cache lacks or has for another commit. heads, cached: (path, head)."""
    return heads.select("path", "head").join(cached.select("path", "head").distinct(), ["path", "head"], "left_anti")


def refreshed_blame(spark: SparkSession, folder: str, heads: DataFrame, blame: Callable[[DataFrame], DataFrame], *, slots: int = SLOTS) -> DataFrame:
    """(path, head, line, sha) of all tracked files, kept in `folder`.

    heads: (path, head), the last commit of each tracked file. Only files whose head changed go to `blame`
    (from (path, head) to (path, line, sha)). Files are dealt over `slots` partitions by a hash of their path;
    partitions with a changed or dropped file are written anew, all others stay as they are on disk. A file
    without lines keeps a row with line null, so that it isn't read again.
    """
    schema = "path string, head string, line int, sha string, slot int"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    old = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
    slot = F.pmod(F.xxhash64("path"), F.lit(slots)).cast("int")
    todo = cut(changed_heads(heads, old))
    dropped = old.select("path").distinct().join(heads.select("path"), "path", "left_anti")
    touched = cut(todo.select("path").unionByName(dropped).select(slot.alias("slot")).distinct())
    new = todo.join(blame(todo).select("path", F.col("line").cast("int").alias("line"), "sha"), "path", "left").select("path", "head", "line", "sha", slot.alias("slot"))
    kept = old.join(F.broadcast(touched), "slot", "left_semi").join(heads.select("path", "head"), ["path", "head"], "left_semi")  # at most `slots` rows
    rows = cut(kept.select("path", "head", "line", "sha", "slot").unionByName(new))
    empty = touched.join(rows.select("slot").distinct(), "slot", "left_anti").select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("sha"), "slot")
    rows.unionByName(empty).repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(folder)
    return spark.read.schema(schema).parquet(folder).where("path is not null").drop("slot")
