"""From raw documents to a training mix: five stages, each the work of one operator of loamline.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import decontaminate, line_dedup, mixing, quality_model, simhash
from loamline.llm.shared import dropped, released, table, table_path


def _own(struct_rows: DataFrame, columns: list[str]) -> DataFrame:
    return struct_rows.select(*[F.col(f"row.`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: rejected ones, junk or toxic, go.

    Null and empty texts are judged by their group alone, repeated rows alike; an empty table stays empty.
    """
    scored = quality_model.scored(docs, docs, table(spark, sf_dir, "labels"))
    return _own(scored.where("kept"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals; n_chars follows. Documents whose words are all gone go.

    Null, empty and blank texts lose nothing and stay. Of rows with equal keys the one of smaller text hash
    is the earlier; rows repeated in full lose the same lines.
    """
    found = line_dedup.without_repeats(docs)
    text = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_gone") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.where("n_gone = 0 or n_gone < n_lines").select(*[text.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest doc_id (null last; ties by text hash, so one of repeated rows). Null and empty texts are one component."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages. Null and empty texts stay; an empty benchmark contaminates nothing."""
    found = decontaminate.annotated(docs, table(spark, sf_dir, "benchmark"))
    return _own(found.where("not contaminated"), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: each document as often as its source's target takes it, numbered in `copy` (`copy_` and so on, if documents have such a column). Documents without a word have no size and are taken by their source's rate; a source without words gives none."""
    number = "copy"
    while number in (c.lower() for c in docs.columns):
        number += "_"
    return mixing.emitted(docs, number=number)


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", decontamination), ("mixing", mixture)]

#: The classifier is fitted and the mix is drawn by hash, so SQL can't express the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, in order. Each stage's rows are written once to the shared folder; what it made on the way and its predecessor's rows are deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = table_path(spark)
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            dropped(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
