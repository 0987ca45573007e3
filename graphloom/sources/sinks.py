"""File sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut, join_checked


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Writes as Parquet, JSON lines, CSV or ORC, partitioned by columns if asked."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if kind == "csv":
        writer = writer.option("header", "true")
    writer.format(kind).save(path)


def snapshot(files: DataFrame, path: str) -> None:
    """The manifest of a walk (path, size, mtime, sha1) as JSON lines."""
    write(files.select("path", "size", F.col("mtime").cast("string").alias("mtime"), "sha1"), path, "json")


def byte_batches(rows: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """The batch number of each row of a group `grp` so that batches hold at most about `most` bytes: by the
    running sum in the order of the key within each group. Sums run inside range-partitioned blocks, on
    top of the totals of the blocks before, so no group passes through one task."""
    placed = cut(rows.repartitionByRange("grp", key).withColumn("_block", F.spark_partition_id()), "placed")
    totals = placed.groupBy("grp", "_block").agg(F.sum(size).alias("_total"))
    before = F.sum("_total").over(Window.partitionBy("grp").orderBy("_block")) - F.col("_total")
    offsets = cut(totals.select("grp", "_block", before.alias("_before")), "offsets")
    upto = F.sum(size).over(Window.partitionBy("grp", "_block").orderBy(key)) + F.col("_before")
    summed = join_checked(placed, offsets, ["grp", "_block"])
    return summed.withColumn("batch", F.floor((upto - 1) / most)).drop("_block", "_before")


def halved(rows: DataFrame, by: list[str], key: str, size: str, most: int, rounds: int = 40) -> DataFrame:
    """rows with a column `part`: a batch (columns by) of more than `most` bytes is split in half by its rows
    in the order of the key, its halves likewise, until each fits or is a single row. A round handles all
    batches at once; their number grows with the logarithm of the largest batch. Rows are numbered inside
    range-partitioned blocks, on top of the counts of the blocks before, so no batch passes through one task."""
    parts = cut(rows.withColumn("part", F.lit("")), "parts")
    for _ in range(rounds):
        place = [*by, "part"]
        large = parts.groupBy(*place).agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_n")).where((F.col("_bytes") > most) & (F.col("_n") > 1)).select(*place, "_n")
        large = cut(large, "large")
        if large.isEmpty():
            return parts
        todo = cut(join_checked(parts, large, place).repartitionByRange(*place, key).withColumn("_block", F.spark_partition_id()), "todo")
        counts = todo.groupBy(*place, "_block").agg(F.count(F.lit(1)).alias("_rows"))
        before = F.sum("_rows").over(Window.partitionBy(*place).orderBy("_block")) - F.col("_rows")
        offsets = cut(counts.select(*place, "_block", before.alias("_before")), "offsets")
        turn = F.row_number().over(Window.partitionBy(*place, "_block").orderBy(key)) + F.col("_before")
        todo = join_checked(todo, offsets, [*place, "_block"]).withColumn("part", F.concat("part", F.when(turn <= F.ceil(F.col("_n") / 2), "a").otherwise("b"))).drop("_n", "_block", "_before")
        parts = cut(join_checked(parts, large.drop("_n"), place, "left_anti").unionByName(todo), "parts")
    raise RuntimeError(f"halved: a batch of more than 2**{rounds} rows")


def write_by_size_or_time(stream: DataFrame, path: str, log: str, size: str, most: int, seconds: int):
    """Starts a stream that writes what has come at least every `seconds` (the trigger), in files of at most
    about `most` bytes by the column size: a batch beyond that is halved. Returns the running query."""

    def flush(batch: DataFrame, number: int) -> None:
        split = halved(batch.withColumn("_k", F.monotonically_increasing_id()).withColumn("_batch", F.lit(number)), ["_batch"], "_k", size, most)
        split.repartition("_batch", "part").drop("_k").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", log).trigger(processingTime=f"{seconds} seconds").start()
