"""Structured Streaming over the event table: windows, stateful debounce, stream-static joins."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.functions.scratch import exists, scratch_dir
from graphloom.sources.files import walk


def stream_of(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 100) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of part files."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    single = any(f.rstrip("/").endswith(f"/{name}.parquet") for f in batch.inputFiles())
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_trigger)
    if single:
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet files of the shared folder, with its own
    checkpoint, and reads them back. Exactly once through the file sink's log."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed_counts(events: DataFrame, delay: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and value sums by window and type; in append mode only windows that the watermark closed."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "v")


def sessions(events: DataFrame, delay: str, gap: str) -> DataFrame:
    """Sessions of each user by gap."""
    rows = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def accepted(times: list[int], last: int | None, gap: int) -> tuple[list[bool], int | None]:
    """Which of ascending times lie at least gap after the last accepted one."""
    flags = []
    for t in times:
        take = last is None or t - last >= gap
        flags.append(take)
        last = t if take else last
    return flags, last


def debounce(events: DataFrame, gap_seconds: int, delay: str = "7 days") -> DataFrame:
    """event_id, user_id, ts, accepted: an event is accepted if its user's last accepted one is at least gap
    earlier; the last accepted time is the state of the user. The same rule with the flag reversed is a
    cache with a time to live: an event within the gap is a hit.

    A state says nothing more once the gap after it is over, so it is dropped when the watermark gets there:
    what is held are the users of the last gap and delay, not all that were ever seen. Events that come more
    than `delay` after the latest one are left out."""
    gap = gap_seconds * 1_000_000

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([f for f in frames if len(f)]).sort_values(["at", "event_id"])
        flags, last = accepted(rows["at"].tolist(), state.get[0] if state.exists else None, gap)
        over = (last + gap) // 1000
        if over > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp(over)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "ts": rows["shown"], "accepted": flags})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.select("event_id", "user_id", "ts", F.unix_micros("ts").alias("at"), F.col("ts").cast("timestamp_ntz").alias("shown")).groupBy("user_id").applyInPandasWithState(
        step, "event_id long, user_id long, ts timestamp_ntz, accepted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def cache_hits(events: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Stream-static left join: whether each event's key is in the cache."""
    known = cache.select(F.col(key).alias("_known")).distinct()
    return events.join(known, F.col(key) == F.col("_known"), "left").withColumn("hit", F.col("_known").isNotNull()).drop("_known")


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (create, modify or delete) and sha1 between two manifests (path, sha1) of a folder; a file
    whose bytes are the same gives none."""
    old, new = before.select("path", F.col("sha1").alias("old")), after.select("path", F.col("sha1").alias("new"))
    kind = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "modify")
    return old.join(new, "path", "full").select("path", kind.alias("change"), F.col("new").alias("sha1")).where("change IS NOT NULL")


def watch(spark: SparkSession, folder: str, base: str, seconds: int = 1, pattern: str = "*"):
    """Starts a watcher of a folder: at every tick the folder is walked and held against the manifest of the
    tick before, and the changes are appended below base/events. Several writes to a file between two ticks
    are one event, so a tick is the debounce; a tick that is run again writes the same. Returns the running
    query. Deletions are found too, which a file stream alone does not see."""
    empty = "path string, sha1 string"

    def tick(_, number: int) -> None:
        seen = walk(spark, folder, pattern).select("path", "sha1")
        seen.write.mode("overwrite").parquet(f"{base}/manifest-{number % 2}")
        last = f"{base}/manifest-{(number + 1) % 2}"
        before = spark.read.schema(empty).parquet(last) if number and exists(spark, last) else spark.createDataFrame([], empty)
        changes = file_changes(before, spark.read.schema(empty).parquet(f"{base}/manifest-{number % 2}"))
        changes.coalesce(1).write.mode("overwrite").parquet(f"{base}/events/tick={number}")

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", f"{base}/log").trigger(processingTime=f"{seconds} seconds").start()
