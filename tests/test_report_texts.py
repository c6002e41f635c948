"""Texts of coverage reports don't grow with the tables."""

from pyspark.sql import functions as F

from loamline.plans import source_text


def test_reports_come_in_bounded_texts(spark):
    found = source_text.reports(spark, "/root/testdata/sf0.01").where("name = 'coverage.json' or name like '%.xml'")  # 2000 parts
    files = F.size(F.regexp_extract_all("value", F.lit(r"src/[^\"]*_(\d+)\."), F.lit(1)))
    shards = F.array_distinct(F.transform(F.regexp_extract_all("value", F.lit(r"src/[^\"]*_(\d+)\."), F.lit(1)), lambda x: F.floor(x.cast("long") / 1000)))
    got = found.select("repo", files.alias("files"), F.size(shards).alias("shards")).where("files > 0").collect()
    assert got and all(r.shards == 1 for r in got)
