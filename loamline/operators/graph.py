"""Reachability and components over edge tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set by hand. Only where all runs on one machine may it be a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isEmpty():
        return found.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="loamline-")


def cut(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder; the plan starts anew from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Rows written once as a table in the shared folder, compressed and read column by column: for large ones that are read often."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a counted table goes to every executor.
FEW = 100_000


def sized(df: DataFrame) -> DataFrame:
    """Rows as of `cut`, counted: few go to every executor, more meet the other side by key. Spark alone goes by the size of Parquet files, in which millions of paths seem small."""
    rows = cut(df)
    return F.broadcast(rows) if rows.count() <= FEW else rows.hint("merge")


def components(edges: DataFrame, a: str = "f1", b: str = "f2") -> DataFrame:
    """(node, root): root is the smallest node that node is connected with.

    Labels jump along their own labels in each round, so rounds grow with the logarithm of a component's
    diameter, not with the diameter. Minima are aggregated before the shuffle.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")))
    while True:
        seen = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        low = labels.join(seen, "u").select("u", "root", F.least("root", "other").alias("next"))
        hooks = low.groupBy(F.col("root").alias("r")).agg(F.min("next").alias("hook"))  # a root takes over what any of its nodes has seen
        hooked = low.join(hooks, low["root"] == hooks["r"]).select("u", "root", F.least("next", "hook").alias("next"))
        jump = hooked.select(F.col("u").alias("w"), F.col("next").alias("far"))
        new = cut(hooked.join(jump, hooked["next"] == jump["w"], "left").select("u", "root", F.least("next", F.coalesce("far", "next")).alias("next")))
        changed = new.where("next <> root").limit(1).count()
        labels = new.select("u", F.col("next").alias("root"))
        if not changed:
            return labels.select(F.col("u").alias("node"), "root")


def reach(edges: DataFrame, seeds: DataFrame, *, depth: int = 3, most: int | None = None) -> DataFrame:
    """(seed, node, depth) of nodes within `depth` edges src -> dst of each seed, with the least depth.

    seeds: (seed, node). With `most`, each seed keeps its first `most` nodes by depth and name; one that is full
    is not followed further.
    """
    steps = kept(edges.select("src", "dst").distinct())  # read once for each level
    found = cut(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)))
    level = found
    if most is not None:
        level = found = found.withColumn("i", F.row_number().over(W.partitionBy("seed").orderBy("node"))).where(F.col("i") <= most).drop("i")
    for d in range(1, depth + 1):
        if most is not None:
            room = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < most)
            level = level.join(room, "seed")
        level = level.hint("merge")
        step = level.join(steps, level["node"] == steps["src"]).select("seed", F.col("dst").alias("node"), *([] if most is None else ["n"])).distinct()
        new = step.join(found.hint("merge"), ["seed", "node"], "left_anti")
        if most is not None:
            place = F.row_number().over(W.partitionBy("seed").orderBy("node"))
            new = new.withColumn("place", place).where(F.col("place") <= most).where(f"place + n <= {most}").select("seed", "node")
        level = (kept if most is None else cut)(new.withColumn("depth", F.lit(d)))
        found = found.unionByName(level)
    return found


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, files, internal, external, cohesion): edges inside and out of each cluster of `members` (cluster, path); inside / n(n-1), 1.0 for single files."""
    e = edges.join(members.select(F.col("path").alias("src"), F.col("cluster").alias("a")), "src").join(members.select(F.col("path").alias("dst"), F.col("cluster").alias("b")), "dst", "left")
    inside = e.groupBy(F.col("a").alias("cluster")).agg(F.count_if(F.col("a") == F.col("b")).alias("internal"), F.count_if((F.col("a") != F.col("b")) | F.col("b").isNull()).alias("external"))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("files"))
    out = size.join(inside, "cluster", "left").na.fill(0, ["internal", "external"])
    return out.withColumn("cohesion", F.when(F.col("files") < 2, F.lit(1.0)).otherwise(F.round(F.col("internal") / (F.col("files") * (F.col("files") - 1)), 6)))


def import_clusters(edges: DataFrame, files: DataFrame, *, shared_limit: int = 3, floor: int = 8, per: int = 30, shared_dirs: tuple[str, ...] = ("shared", "common", "utils", "lib", "ui", "types", "config")) -> DataFrame:
    """Edges (src, dst) that hold a cluster together: both ends in one domain, and the target no hub. files: (path, domain)."""
    fan = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("fan_in"))
    n = files.count()
    shared = F.arrays_overlap(F.split("dst", "/"), F.array(*map(F.lit, shared_dirs)))
    limit = F.when(shared, shared_limit).otherwise(max(floor, n // per))
    d = files.select("path", "domain")
    met = edges.join(fan, "dst").join(d.select(F.col("path").alias("src"), F.col("domain").alias("sd")), "src").join(d.select(F.col("path").alias("dst"), F.col("domain").alias("dd")), "dst")
    return met.where((F.col("sd") == F.col("dd")) & (F.col("fan_in") <= limit)).select("src", "dst")


def promoted(edges: DataFrame, buckets: DataFrame, least: int = 3) -> DataFrame:
    """(path, importers): documentation and infrastructure files that at least `least` source files import."""
    b = buckets.select("path", "bucket")
    src = b.where("bucket = 'source'").select(F.col("path").alias("src"))
    dst = b.where("bucket in ('documentation', 'infrastructure')").select(F.col("path").alias("dst"))
    return edges.join(src, "src").join(dst, "dst").groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("importers")).where(F.col("importers") >= least)
