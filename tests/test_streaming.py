"""Streams replayed from files until nothing is left."""

import datetime

from pyspark.sql import functions as F

from loamline.streaming import watch

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def stream(spark, path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_debounce_emits_one_row_for_a_burst(spark, tmp_path):
    rows = [[("r", at(0)), ("r", at(10)), ("r", at(20))], [("r", at(100))], [("r", at(900))]]
    q = watch.debounced(stream(spark, tmp_path / "in", rows, "repo string, ts timestamp")).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.ended, r.n) for r in spark.sql("select * from bursts order by started").collect()][:2] == [(at(20), 3), (at(100), 1)]


def test_throttle_accepts_after_a_pause(spark, tmp_path):
    rows = [[("r", at(s)) for s in (0, 10, 299)] + [("q", at(5))], [("r", at(s)) for s in (301, 500, 602)]]
    s = stream(spark, tmp_path / "in", rows, "repo string, ts timestamp")
    q = watch.throttled(s).writeStream.format("memory").queryName("accepted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {("r", at(0)), ("r", at(301)), ("r", at(602)), ("q", at(5))}
    assert {(r.repo, r.ts) for r in spark.table("accepted").collect()} == want
    whole = spark.createDataFrame([x for part in rows for x in part], "repo string, ts timestamp")
    assert {(r.repo, r.ts) for r in watch.throttle_batch(whole).collect()} == want


def test_batches_are_bounded(spark, tmp_path):
    rows = [[(i, at(i)) for i in range(450)]]
    seen = []
    q = watch.flush_batches(stream(spark, tmp_path / "in", rows, "id int, ts timestamp"), lambda df, e: seen.extend(r["count"] for r in df.groupBy("batch").count().collect()), str(tmp_path / "c"), once=True)
    q.awaitTermination()
    assert sum(seen) == 450 and max(seen) <= 200


def test_counters_follow_the_stream(spark, tmp_path):
    rows = [[(1, "a", True), (1, "a", True), (2, "a", False)], [(3, "b", True)]]
    s = stream(spark, tmp_path / "in", rows, "sha int, feature string, is_bug_fix boolean")
    watch.keep_counters(s, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    version = (tmp_path / "t" / "current").glob("part-*")
    name = next(iter(version)).read_text().strip()
    got = {(r.feature, r.total_commits, r.bug_fixes) for r in spark.read.parquet(str(tmp_path / "t" / name)).collect()}
    assert got == {("a", 2, 1), ("b", 1, 1)}


def test_windows(spark, tmp_path):
    rows = [[("view", at(10), 1.0), ("view", at(20), 2.0), ("click", at(4000), 3.0)], [("view", at(20000), 1.0)]]
    q = watch.windowed_activity(stream(spark, tmp_path / "in", rows, "event_type string, ts timestamp, value double")).writeStream.format("memory").queryName("activity").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.event_type, r.n, r.total) for r in spark.table("activity").where(F.col("start") < at(5000)).collect()} == {("view", 2, 3.0), ("click", 1, 3.0)}


def test_throttle_of_one_long_burst(spark):
    import random

    rng = random.Random(1)
    times = sorted(rng.sample(range(0, 40_000), 900)) + [90_000, 90_300, 90_599, 90_600]
    last, want = None, set()
    for t in times:
        if last is None or t - last >= 300:
            want.add(at(t))
            last = t
    got = watch.throttle_batch(spark.createDataFrame([("r", at(t)) for t in times] + [("r", at(times[0]))], "repo string, ts timestamp"))
    assert [r.ts for r in got.orderBy("ts").collect()] == sorted(want)
