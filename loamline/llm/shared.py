"""What several operators of this subpackage need: tables, lineage cuts, rows carried along."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words, as a Java pattern.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
    """The rows of df, computed once and written to the checkpoint folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_scopes: list[tuple[list[str], list[Broadcast]]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within it, operators' broadcasts and the tables that they store are noted; at its end they are destroyed and deleted. What depends on them must have been written by then."""
    _scopes.append(([], []))
    try:
        yield
    finally:
        paths, broadcasts = _scopes.pop()
        for b in broadcasts:
            b.unpersist()
        for p in paths:
            dropped(spark, p)


def dropped(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sent(spark: SparkSession, value: Any) -> Broadcast:
    out = spark.sparkContext.broadcast(value)
    if _scopes:
        _scopes[-1][1].append(out)
    return out


def table_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of df as a table written to the shared checkpoint folder, and its path; Spark knows the size of what it reads there."""
    spark = df.sparkSession
    path = table_path(spark)
    if _scopes:
        _scopes[-1][0].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """As stored_at, the rows alone."""
    return stored_at(df)[0]


#: Hashes up to which a bitmap pays: at four bits for each of so many, three quarters of the others are kept out.
MOST_MARKS = 1 << 24


class Marks(NamedTuple):
    bitmap: DataFrame
    shift: int


def marks(hashes: DataFrame) -> Marks | None:
    """A bitmap over a column `h` of 64-bit hashes as rows (slot, bits), of eight bits and more for each, of 2**26 bits at most; none if there are over MOST_MARKS, as it would pass too much."""
    n = hashes.count()
    if n > MOST_MARKS:
        return None
    shift = 64 - min(max((n // 8).bit_length() + 1, 8), 20)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    return Marks(stored(hashes.groupBy(F.shiftrightunsigned("h", shift).alias("slot")).agg(F.bit_or(bit).alias("bits"))), shift)


def marked(rows: DataFrame, h: str, by: Marks | None, how: str = "left_semi") -> DataFrame:
    """Rows whose hash is marked, and by chance some more (with left_anti: the others). The bitmap's bound is fixed, so it goes to every executor; without one all rows may be marked."""
    if by is None:
        return rows if how == "left_semi" else rows.limit(0)
    b = F.broadcast(by.bitmap)
    hit = (F.shiftrightunsigned(rows[h], by.shift) == b["slot"]) & (F.getbit(b["bits"], rows[h].bitwiseAND(F.lit(63)).cast("int")) == 1)
    return rows.join(b, hit, how)


#: Bytes of an Arrow batch, where the session names no other bound. The bound by rows stays; it alone would put ten thousand texts of any length in a batch.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow in batches bounded by bytes, on executors that get this package from the driver if they lack it."""
    sc = df.sparkSession.sparkContext
    if _BATCH not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="loamline-"), "loamline.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_text(docs: DataFrame, text: str, run: Callable[[pa.Array], dict[str, pa.Array]], more: str) -> DataFrame:
    """All rows and columns of docs as struct column `row`, with what `run` makes of the batch's texts.

    The struct keeps columns of docs apart from the new ones, whatever their names. Texts are read out of
    it, so they go to Python once; only a column that is no string is sent a second time, cast.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    at = docs.columns.index(text)
    if docs.schema[at].dataType != T.StringType():
        packed = packed.withColumn("text", docs[text].cast("string"))
    schema = T.StructType([packed.schema["row"], *T._parse_datatype_string(more).fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = run(b.column(1) if b.num_columns > 1 else b.column(0).field(at))
            yield pa.RecordBatch.from_arrays([b.column(0), *new.values()], names=["row", *new])

    return mapped(packed, each, schema)
