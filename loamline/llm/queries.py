"""The queries of this subpackage: each applies its operator to whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import table, table_path


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit, judged

    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import document_classes

    return document_classes(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licence_scan

    return licence_scan(table(spark, sf_dir, "documents"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import coded

    return coded(table(spark, sf_dir, "embeddings"))


def op12_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .id_planes import written_and_read

    return written_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), table_path(spark))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracles import OP7, OP10, OP11, OP13

    return {"op7_decontamination": OP7, "op10_line_dedup": OP10, "op11_vector_codes": OP11, "op13_prefix_trie": OP13}
