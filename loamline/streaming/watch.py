"""Stream-shaped parts: debounce, throttle, batches, and counters kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import refresh
from ..operators.graph import cut
from ..sources import versions


def debounced(events: DataFrame, *, gap: str = "30 seconds", late: str = "1 minute", keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """(keys, started, ended, n): one row for each burst of events, once `gap` has passed in silence. Events later than `late` are left out. events: (ts, keys)."""
    burst = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(*keys, burst.alias("burst")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ended"))
    return out.select(*keys, F.col("burst.start").alias("started"), "ended", "n")


def throttled(requests: DataFrame, *, seconds: int = 300, key: str = "repo") -> DataFrame:
    """(key, ts): requests accepted at least `seconds` after the last accepted one of their key. State is one time for each key. Batches are taken in order of time."""

    def accept(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for f in frames for t in f["ts"].astype("int64").tolist()):
            if last is None or t - last >= seconds * 1_000_000_000:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), "ts": pd.to_datetime(kept)})

    kind = requests.schema[key].dataType.simpleString()
    nanos = requests.select(key, "ts")
    return nanos.groupBy(key).applyInPandasWithState(accept, f"{key} {kind}, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def throttle_batch(requests: DataFrame, *, seconds: int = 300, key: str = "repo") -> DataFrame:
    """The same acceptance over a finished table, for keys with any number of requests.

    A request after `seconds` of silence is always accepted. From each request the next one that could be
    accepted after it is looked up in blocks of `seconds`: it stands in the block after, or is the first of
    the next block with any. Those links are then followed from the accepted ones by pointer jumping, in
    rounds logarithmic in the length of a burst, so no burst is held in one task.
    """
    pause = seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    times = cut(requests.select(key, "ts", micros.alias("t")).distinct().withColumn("block", F.floor(F.col("t") / pause)))
    # events, and questions a pause later, meet in their block: the nearest event at or after each question
    asked = times.select(key, (F.col("block") + 1).alias("block"), (F.col("t") + pause).alias("at"), F.lit(None).cast("long").alias("event"), F.col("t").alias("t"))
    both = asked.unionByName(times.select(key, "block", F.col("t").alias("at"), F.col("t").alias("event"), F.lit(None).cast("long").alias("t")))
    after = F.last("event", True).over(W.partitionBy(key, "block").orderBy(F.desc("at"), F.col("event").isNull()).rowsBetween(W.unboundedPreceding, 0))
    firsts = times.groupBy(key, "block").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    b = W.partitionBy(key).orderBy("block")
    blocks = cut(firsts.select(key, "block", "first", F.lag("last").over(b).alias("before"), F.lead("first").over(b).alias("following"), F.lead("block").over(b).alias("next_block")))
    near = both.withColumn("next", after).where("t is not null").select(key, "block", "t", "next")
    here = blocks.select(key, F.col("block").alias("own"), "following", "next_block")
    beyond = blocks.select(key, F.col("block").alias("next_block"), F.col("following").alias("second"))
    met = near.withColumn("own", F.col("block") - 1).join(here, [key, "own"]).join(beyond, [key, "next_block"], "left")
    # the block after may lie apart, and then its first is the answer; if it is there but too early, the first of the one behind it
    jump = F.coalesce("next", F.when(F.col("next_block") > F.col("block"), F.col("following")).otherwise(F.col("second")))
    jumps = cut(met.select(key, "t", jump.alias("next")))
    starts = times.join(blocks, [key, "block"]).where("t = first and (before is null or t - before >= " + str(pause) + ")").select(key, "t")
    kept = cut(starts)
    while True:
        more = cut(kept.join(jumps, [key, "t"]).where("next is not null").select(key, F.col("next").alias("t")).join(kept, [key, "t"], "left_anti").distinct())
        if more.isEmpty():  # what is kept is closed under this jump, and so under all steps
            break
        kept = cut(kept.unionByName(more))
        far = jumps.select(key, F.col("t").alias("next"), F.col("next").alias("far"))
        jumps = cut(jumps.join(far, [key, "next"]).select(key, "t", F.col("far").alias("next")).where("next is not null"))
    return times.join(kept, [key, "t"]).select(key, "ts")


def flush_batches(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, *, every: str = "60 seconds", most: int = 200, once: bool = False) -> StreamingQuery:
    """Hands events on in batches of at most `most` rows (column batch), every so often. The checkpoint makes a restart go on where it stopped."""

    def each(df: DataFrame, epoch: int) -> None:
        numbered = df.withColumn("batch", F.expr(f"monotonically_increasing_id() & {(1 << 33) - 1}"))
        send(numbered.withColumn("batch", F.concat_ws("-", F.spark_partition_id().cast("string"), F.expr(f"batch div {most}").cast("string"))), epoch)

    out = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def updated_counters(counters: DataFrame, touched: DataFrame, commits: DataFrame, key: str = "feature") -> DataFrame:
    """counters (key, total_commits, bug_fixes) plus the new commits, each counted once for a key."""
    new = touched.select("sha", key).distinct().join(commits.select("sha", "is_bug_fix"), "sha").groupBy(key).agg(F.count(F.lit(1)).alias("more"), F.count_if("is_bug_fix").alias("more_bugs"))
    met = counters.join(new, key, "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = met.select(key, (zero("total_commits") + zero("more")).alias("total_commits"), (zero("bug_fixes") + zero("more_bugs")).alias("bug_fixes"))
    return out.withColumn("bug_fix_ratio", F.coalesce(F.round(F.try_divide("bug_fixes", "total_commits"), 3), F.lit(0.0)))


def keep_counters(stream: DataFrame, table: str, checkpoint: str, key: str = "feature") -> StreamingQuery:
    """Keeps a parquet table of counters up to date from a stream of (sha, key, is_bug_fix); each epoch writes a new version beside the last and then points to it, so a failed epoch changes nothing."""

    def each(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/current")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        current = spark.read.text(f"{table}/current").first()[0] if fs.exists(path) else None
        if current is not None and int(current.split("-")[0]) >= epoch:
            return
        own = df.select("sha", key, "is_bug_fix").distinct()
        have = spark.read.parquet(f"{table}/{current}") if current else spark.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, total_commits long, bug_fixes long")
        version = f"{epoch}-{uuid.uuid4().hex[:8]}"
        updated_counters(have, own, own.select("sha", "is_bug_fix").distinct(), key).write.parquet(f"{table}/{version}")
        spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{table}/current")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, *, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) over tumbling or sliding windows."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def keep_map(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps a feature map in versions (`features`, `files`, `pull_requests`, published before the start) up to date from a stream of commits' files (sha, path, author, ts, is_bug_fix, pr_number).

    Each epoch publishes one version; one that was published before a restart is not taken again, and a failed
    one leaves the present version as it was. The stream's clock is the epoch's latest commit.
    """

    def each(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        now = versions.present(spark, folder)
        if now is None or now[0] >= epoch + 1 or df.isEmpty():
            return
        t = versions.read(spark, folder)
        rows = df.select("sha", "path", "author", "ts", "is_bug_fix", "pr_number").distinct()
        commits = rows.drop("path").dropDuplicates(["sha"])
        after = refresh.updated(refresh.FeatureMap(t["features"], t["files"], t["pull_requests"]), rows.select("sha", "path"), commits, commits.agg(F.max("ts").alias("as_of")))
        versions.publish(spark, folder, epoch + 1, after._asdict())

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
