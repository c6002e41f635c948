"""Partial scans against full ones, versions, and a map kept by a stream."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from loamline.operators import refresh as R
from loamline.sources import versions
from loamline.streaming import watch

DAY = datetime.datetime(2024, 5, 1)


def by_folder(todo):
    return todo.select(F.substring_index("path", "/", 1).alias("feature"), "path")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_carried_and_rescanned_equal_a_full_scan(spark):
    before = spark.createDataFrame([(f"{d}/{i}.ts",) for d in "abcde" for i in range(4)], "path string")
    changes = [("a/1.ts", "modified"), ("b/0.ts", "removed"), ("c/9.ts", "added"), ("f/0.ts", "added")] + [(f"e/{i}.ts", "removed") for i in range(4)]
    diff = spark.createDataFrame(changes, "path string, status string")
    after = before.join(diff.where("status = 'removed'"), "path", "left_anti").unionByName(diff.where("status = 'added'").select("path"))
    assert pairs(R.executed(by_folder(before), diff, by_folder).where("feature <> 'c'")) == pairs(by_folder(after).where("feature <> 'c'"))
    seen = []
    got = R.executed(by_folder(before), diff, lambda todo: seen.extend(r.path for r in todo.collect()) or by_folder(todo))
    assert sorted(seen) == ["a/0.ts", "a/1.ts", "a/2.ts", "a/3.ts", "b/1.ts", "b/2.ts", "b/3.ts", "c/9.ts", "f/0.ts"]
    assert [r.path for r in got.where("feature = 'c'").collect()] == ["c/9.ts"]  # the scan named it, so it wins whole
    gone = spark.createDataFrame([("a/0.ts", "removed")], "path string, status string")
    one = by_folder(spark.createDataFrame([("a/0.ts",), ("b/0.ts",)], "path string"))
    assert pairs(R.executed(one, gone, by_folder)) == [("b", "b/0.ts")]
    assert pairs(R.executed(one, gone.limit(0), by_folder)) == [("a", "a/0.ts"), ("b", "b/0.ts")]


def test_versions_change_as_one(spark, tmp_path):
    folder, one, two = str(tmp_path / "t"), spark.range(1), spark.range(2)
    assert versions.present(spark, folder) is None and versions.read(spark, folder) == {}
    assert versions.publish(spark, folder, 3, {"a": one, "b": one}) and not versions.publish(spark, folder, 3, {"a": two})
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        versions.publish(spark, folder, 4, {"a": two, "b": two.select(F.expr("1 div (id - id)").alias("id"))})
    assert {k: v.count() for k, v in versions.read(spark, folder).items()} == {"a": 1, "b": 1} and versions.present(spark, folder)[0] == 3
    assert versions.publish(spark, folder, 12, {"a": two}) and {k: v.count() for k, v in versions.read(spark, folder).items()} == {"a": 2}


def start(spark):
    features = spark.createDataFrame([("cart", 10, 2, ["ann"], DAY, 90.0), ("auth", 4, 1, ["bob"], DAY, 80.0)], "feature string, total_commits long, bug_fixes long, authors array<string>, last_modified timestamp, health double")
    files = spark.createDataFrame([("cart", "src/cart/a.ts"), ("auth", "src/auth/a.ts")], "feature string, path string")
    return R.FeatureMap(features, files, spark.createDataFrame([("cart", 7, 1, DAY)], "feature string, pr_number int, sha long, ts timestamp"))


COMMITS = "sha long, path string, author string, ts timestamp, is_bug_fix boolean, pr_number int"


def test_a_stream_keeps_the_map(spark, tmp_path, monkeypatch):
    folder, source, state = str(tmp_path / "map"), str(tmp_path / "in"), str(tmp_path / "state")
    versions.publish(spark, folder, 0, start(spark)._asdict())
    later = DAY + datetime.timedelta(days=3)

    def arrive(rows):
        spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(source)

    def run():
        watch.keep_map(spark.readStream.schema(COMMITS).parquet(source), folder, state).awaitTermination(120)

    arrive([(11, "src/cart/a.ts", "cy", later, True, 7), (11, "src/cart/b.ts", "cy", later, True, 7), (12, "lib/authPage.ts", "ann", later, False, None), (13, "zz/none.ts", "ann", later, True, 9)])
    run()
    t = versions.read(spark, folder)
    got = {r.feature: (r.total_commits, r.bug_fixes, r.authors, r.last_modified, round(r.health, 3)) for r in t["features"].collect()}
    health = lambda x, n: round(100 / (1 + math.exp(8 * (x - 0.55))) * (0.8 + 0.2 * n / 50), 3)
    assert got == {"cart": (11, 3, ["ann", "cy"], later, health(1, 11)), "auth": (5, 1, ["ann", "bob"], later, health(0, 5))}
    assert pairs(t["files"]) == [("auth", "lib/authPage.ts"), ("auth", "src/auth/a.ts"), ("cart", "src/cart/a.ts"), ("cart", "src/cart/b.ts")]
    assert [(r.pr_number, r.sha) for r in t["pull_requests"].collect()] == [(7, 11)]
    run()  # nothing new
    assert versions.present(spark, folder)[0] == 1
    arrive([(14, "lib/authPage.ts", "di", later, False, None)])
    publish = versions.publish
    monkeypatch.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        run()
    assert versions.present(spark, folder)[0] == 1 and versions.read(spark, folder)["features"].where("total_commits = 5").count() == 1
    monkeypatch.setattr(versions, "publish", publish)
    run()
    assert versions.present(spark, folder)[0] == 2 and versions.read(spark, folder)["features"].where("feature = 'auth'").first().total_commits == 6


def test_owners_of_many_files_meet_by_key(spark, monkeypatch, tmp_path):
    from loamline.operators import graph

    def read(rows, schema, name):  # from Parquet, of which Spark believes that it is small
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    files = read([("auth", "src/auth/a.ts"), ("auth", "src/b.ts"), ("billing", "src/billing/c.ts")], "feature string, path string", "files")
    new = read([("src/auth/a.ts",), ("src/auth/new.ts",), ("lib/billing/x.ts",), ("zz/auth.ts",), ("zz/none.ts",)], "path string", "new")
    want = [("lib/billing/x.ts", "billing", "directory"), ("src/auth/a.ts", "auth", "exact"), ("src/auth/new.ts", "auth", "ancestor"), ("zz/auth.ts", "auth", "stem"), ("zz/none.ts", None, None)]
    assert pairs(R.new_owner(new, files)) == want
    monkeypatch.setattr(graph, "FEW", 0, raising=False)
    got = R.new_owner(new, files)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (got, R.nearest_owner(new, files))]
    assert not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans) and pairs(got) == want
