"""Training-order materialisation of token ids.

Documents are encoded once; every document gives sequences of a fixed number of tokens (the last is
padded). Sequences are numbered densely, independent of the table's file layout: documents are dealt
to hash buckets, ordered by hash and id within a bucket, and buckets get offsets from their counts. A
keyed Feistel permutation of [0, 2**bits) with cycle-walking turns the number into a slot of [0, N),
so the order is a pseudo-random permutation that needs no sort of all sequences. Slots are dealt to
range partitions that begin at shard edges, and each partition writes its shards: a file of records of
one stride (the ids, then a line feed). This is done volume by volume, a range of shards at a time, so
that only a part of the payload is in a shuffle at once and a broken run goes on with its next volume. Slot s lies at byte (s mod rows) * stride of shard s div rows,
and a reader goes on from any slot. An index table next to the shards says which document a slot
holds. Everything is written by Spark's own writers, so the folder may be on any file system of the
cluster, and a task that is run again leaves nothing twice.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut, exists, scratch_dir, shuffles_removed
from graphloom.llm import tokens
from graphloom.llm.texts import mix, small_batches

LENGTH = 512
SHARD_ROWS = 4096
#: Documents of a hash bucket, in which sequences are numbered in one task; and the fewest buckets.
BUCKET_ROWS, FEWEST = 20_000, 64
#: Bytes of shards that one task writes, about.
TASK_BYTES = 64 << 20
#: Ranges of shards that are written one after the other.
VOLUMES = 4
ROUNDS = 6


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of [0, n): Feistel rounds over the next even power of two, walked until the
    value falls below n. Every walk ends, since the rounds permute the larger domain."""
    bits = max(2, (max(n, 2) - 1).bit_length())
    half = np.uint64((bits + 1) // 2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % 2**64))
    value = index.astype(np.uint64)
    todo = np.arange(len(value))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = value[todo] >> half, value[todo] & mask
            for k in keys:
                left, right = right, left ^ (mix(right + k) & mask)
            value[todo] = (left << half) | right
            todo = todo[value[todo] >= n]
    return value.astype(np.int64)


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast, length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> sequences with their position in the bucket."""
    encode = tokens.encoder(vocabulary.value)
    bucket, at = None, 0
    for batch in small_batches(batches, 256):
        out: list[list] = [[], [], [], [], [], []]
        texts = batch.column(2).to_pylist()
        for row, ids in enumerate(encode.encode_ordinary_batch([t or "" for t in texts], num_threads=1)):
            mine = batch.column(0)[row].as_py()
            bucket, at = mine, at if mine == bucket else 0
            ids = np.array([*ids, tokens.END_OF_TEXT], dtype="<u2")
            for part, start in enumerate(range(0, len(ids), length)):
                piece = ids[start : start + length]
                for column, value in zip(out, (mine, at, batch.column(1)[row].as_py(), part, len(piece), piece.tobytes())):
                    column.append(value)
                at += 1
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["bucket", "at", "doc_id", "part", "n_tokens", "ids"])


def _placed(docs: DataFrame, vocabulary: Broadcast, key: int, length: int) -> tuple[DataFrame, int]:
    """(slot, doc_id, part, n_tokens, ids) of every sequence, in no order, and their number."""
    spread = F.xxhash64("doc_id", "text")
    buckets = max(FEWEST, -(-docs.count() // BUCKET_ROWS))
    rows = docs.select(
        F.pmod(spread, F.lit(buckets)).cast("int").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), "text", spread.alias("spread")
    )
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "spread", "doc_id").select("bucket", "doc_id", "text")
    encoded = cut(
        rows.mapInArrow(
            lambda batches: _encode(batches, vocabulary, length),
            "bucket int, at long, doc_id long, part int, n_tokens int, ids binary",
        ),
        "encoded", "zstd",
    )
    # One row a bucket.
    counts = encoded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")
    offsets = cut(counts.select("bucket", before.alias("offset"), "n"), "offsets")
    total = offsets.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("long")
    def slot(index):
        import pandas as pd

        return pd.Series(feistel(index.to_numpy(), total, key))

    placed = encoded.join(F.broadcast(offsets), "bucket").select(
        slot(F.col("offset") + F.col("at")).alias("slot"), "doc_id", "part", "n_tokens", "ids"
    )
    return placed, total


def _payload(length: int):
    return F.rpad(F.col("ids"), F.lit(2 * length), F.lit(np.array([tokens.END_OF_TEXT], "<u2").tobytes()))


def _dealt(placed: DataFrame, first: int, until: int, length: int, shard_rows: int) -> DataFrame:
    """The rows of a range of shards with shard and row, in range partitions that begin at shard edges, sorted."""
    shards = max(1, until - first)
    tasks = min(shards, max(placed.sparkSession.sparkContext.defaultParallelism, -(-shards * shard_rows * 2 * length // TASK_BYTES)))
    rows = placed.where(F.col("slot").between(first * shard_rows, until * shard_rows - 1))
    rows = rows.withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("long")).withColumn("row", F.pmod("slot", F.lit(shard_rows)).cast("int"))
    task = F.floor((F.col("shard") - first) * tasks / shards).cast("int")
    return rows.withColumn("task", task).repartitionById(tasks, "task").sortWithinPartitions("shard", "slot").drop("task")


def training_order(
    docs: DataFrame, vocabulary: Broadcast, key: int = 20240501, length: int = LENGTH, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """slot, shard, row, doc_id, part (number of the sequence in its document), n_tokens (without
    padding) and payload (length little-endian 16-bit ids, padded with the end-of-text id), range-
    partitioned at shard edges and sorted by slot.

    A null or empty text gives one sequence that holds the end-of-text id alone. Null doc_ids and
    repeated rows are encoded like any other; equal rows may swap places, and are numbered in one task.
    Slots are exactly 0..N-1. An empty table gives an empty result. Further columns are ignored.
    """
    placed, total = _placed(docs, vocabulary, key, length)
    return _dealt(placed, 0, -(-total // shard_rows), length, shard_rows).select("slot", "shard", "row", "doc_id", "part", "n_tokens", _payload(length).alias("payload"))


def _manifest(docs: DataFrame, vocabulary: Broadcast, key: int, length: int, shard_rows: int) -> dict:
    """What the bytes of the shards follow from; the input by its number of rows and sums of two hashes."""
    h = [F.xxhash64(F.lit(k), "doc_id", "text") for k in (1, 2)]
    n, a, b = docs.agg(F.count(F.lit(1)), F.sum(h[0].bitwiseAND(F.lit(2**40 - 1))), F.sum(h[1].bitwiseAND(F.lit(2**40 - 1)))).first()
    raw = vocabulary.value
    return {"key": key, "length": length, "shard_rows": shard_rows, "rows": n, "input": [a or 0, b or 0], "vocabulary": hashlib.sha256(raw).hexdigest()}


def write_shards(
    docs: DataFrame, vocabulary: Broadcast, directory: str, key: int = 20240501, length: int = LENGTH, shard_rows: int = SHARD_ROWS
) -> str:
    """Writes the training order below a folder of the cluster and returns the order's own folder.

    Its name is the digest of a manifest: key, length, rows a shard, vocabulary and a digest of the input
    rows, so orders of another key or other texts never mix. shards/volume=V/shard=N holds one file, index
    the rows (slot, shard, row, doc_id, part, n_tokens, crc of the ids), manifest the manifest. The manifest
    is written last: an order that has one is whole and left as it is; one without goes on with the volumes
    that are not committed.
    """
    spark = docs.sparkSession
    said = json.dumps(_manifest(docs, vocabulary, key, length, shard_rows), sort_keys=True)
    folder = f"{directory.rstrip('/')}/order-{hashlib.sha256(said.encode()).hexdigest()[:24]}"
    if exists(spark, f"{folder}/manifest/_SUCCESS"):
        return folder
    placed, total = _placed(docs, vocabulary, key, length)
    shards = -(-total // shard_rows)
    edges = [shards * v // VOLUMES for v in range(VOLUMES + 1)]
    for volume, (first, until) in enumerate(zip(edges, edges[1:])):
        path = f"{folder}/shards/volume={volume}"
        if first < until and not exists(spark, f"{path}/_SUCCESS"):
            dealt = _dealt(placed.select("slot", "ids"), first, until, length, shard_rows)
            with shuffles_removed(spark):
                dealt.select("shard", _payload(length).cast("string").alias("record")).write.mode("overwrite").partitionBy("shard").text(path)
    places = [F.floor(F.col("slot") / shard_rows).cast("long").alias("shard"), F.pmod("slot", F.lit(shard_rows)).cast("int").alias("row")]
    placed.select("slot", *places, "doc_id", "part", "n_tokens", F.crc32(_payload(length)).alias("crc")).write.mode("overwrite").parquet(f"{folder}/index")
    spark.createDataFrame([(said, total)], "settings string, sequences long").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return folder


def read_shards(spark, folder: str, first_slot: int = 0) -> DataFrame:
    """slot and payload of an order from first_slot on; shards before it are not opened."""
    held = spark.read.json(f"{folder}/manifest").first()
    settings = json.loads(held["settings"])
    stride, rows = 2 * settings["length"] + 1, settings["shard_rows"]
    if not held["sequences"]:
        return spark.createDataFrame([], "slot long, payload binary")
    files = spark.read.format("binaryFile").load(f"{folder}/shards").where(F.col("shard") >= first_slot // rows)
    records = files.select("shard", "content", F.explode(F.sequence(F.lit(0), (F.col("length") / stride - 1).cast("int"))).alias("row"))
    slot = (F.col("shard").cast("long") * rows + F.col("row")).alias("slot")
    return records.select(slot, F.substring("content", F.col("row") * stride + 1, F.lit(stride - 1)).alias("payload")).where(F.col("slot") >= first_slot)


def query(spark, sf_dir):
    """Writes the shards of all documents to a new place in the shared folder, so that no earlier run's
    shards are taken for this one's, and returns their index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = write_shards(docs, tokens.vocabulary(spark), f"{scratch_dir(spark)}/training-order-{uuid.uuid4().hex}")
    return spark.read.parquet(f"{folder}/index")
