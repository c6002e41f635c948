"""Tables that change as one: versions beside each other, and a marker that makes one of them the present.

A version's tables are written first; a small marker file, named by its epoch and created only if it isn't
there yet, comes last. Readers take the marker of the highest epoch, so a failed or repeated epoch changes
nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _markers(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/markers")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def present(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """(epoch, path of its tables) of the present version."""
    path, fs = _markers(spark, folder)
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if "~" in s.getPath().getName())
    if not names:
        return None
    epoch, _, version = names[-1].partition("~")
    return int(epoch), f"{folder}/{version}"


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the present version by name; none before the first."""
    now = present(spark, folder)
    if now is None:
        return {}
    path = spark._jvm.org.apache.hadoop.fs.Path(now[1])
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName(): spark.read.parquet(s.getPath().toString()) for s in fs.listStatus(path)}


def publish(spark: SparkSession, folder: str, epoch: int, tables: dict[str, DataFrame]) -> bool:
    """Makes `tables` the version of `epoch`; False if that epoch or a later one is there already."""
    now = present(spark, folder)
    if now is not None and now[0] >= epoch:
        return False
    version = f"version-{epoch}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    path, fs = _markers(spark, folder)
    fs.mkdirs(path)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"{epoch:019d}~{version}"), False).close()
    return True
