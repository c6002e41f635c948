"""Command line: metrics of a git repository, or any registered query over a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, repo: str, days: int):
    """Features of a repository by risk: features are the first telling folders of paths."""
    from .functions import paths as P
    from .operators import attribution as A
    from .sources import history as H

    log = H.log(spark, repo).withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()
    as_of = log.agg(F.max("ts").alias("as_of"))
    log = log.crossJoin(F.broadcast(as_of)).where(F.expr(f"ts >= as_of - interval {int(days)} days")).drop("as_of")
    files = log.select("sha", F.explode("files").alias("path"))
    touched = files.withColumn("feature", P.first_segment(F.col("path")))
    return A.metrics(touched, touched, log, as_of).orderBy(F.desc("bug_fix_ratio"), "feature")


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="loamline", description=__doc__)
    sub = top.add_subparsers(dest="verb", required=True)
    s = sub.add_parser("scan", help="features of a git repository by risk")
    s.add_argument("repo")
    s.add_argument("--days", type=int, default=365)
    r = sub.add_parser("run", help="a registered query")
    r.add_argument("query")
    r.add_argument("tables", help="folder with the parquet tables")
    sub.add_parser("list", help="names of registered queries")
    a = top.parse_args(args)
    from . import plans

    plans.load()
    if a.verb == "list":
        print("\n".join(sorted(plans.QUERIES)))
        return
    spark = SparkSession.builder.appName("loamline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    (scan(spark, a.repo, a.days) if a.verb == "scan" else plans.QUERIES[a.query](spark, a.tables)).show(50, truncate=False)


if __name__ == "__main__":
    main()
