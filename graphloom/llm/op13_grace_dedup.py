"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their digest; a partition is a bucket, and what is written of it lies
in the shared folder. Each bucket builds an open-addressing table of its distinct contents that is probed
with complete contents (a dict of bytes: the hash finds the slot, equality of every byte decides). A bucket
whose distinct contents outgrow the table writes what it holds, and all it has yet to read, as spill
records, and those are partitioned again by another hash of the digest, until every bucket fits.

Hot groups: before anything is shuffled, each task merges the copies it meets in a table of the same kind,
so a bucket gets a content at most once for each table of the tasks before it, and it streams them: the
memory holds one copy. Rows find their group by the digest afterwards; the largest groups, whose number is
bounded, are broadcast, so no key of the shuffled join is hot. Should two contents share a digest, their
rows are matched by the content itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scratch import cut, join_checked

#: Bytes of distinct contents that a table holds.
ROOM = 64 << 20
#: Bytes that a slot takes beside its content.
SLOT = 200
#: Records of one Arrow batch that a table is written in, and their bytes.
ROWS, BYTES = 2000, 8 << 20
#: Groups of more than 1 / HOT of all rows are joined by broadcast: at most HOT of them.
HOT = 10_000

RECORD = pa.schema([("digest", pa.string()), ("content", pa.binary()), ("keep_id", pa.int64()), ("ties", pa.int64()), ("n", pa.int64()), ("spilled", pa.bool_())])
_SCHEMA = "digest string, content binary, keep_id long, ties long, n long, spilled boolean"


class Table:
    """content -> [digest, largest doc_id, rows of that doc_id, rows]; null ids are the smallest."""

    def __init__(self, room: int):
        self.room, self.slots, self.used, self.digests = room, {}, 0, set()

    def add(self, digest: str, content: bytes, keep, ties: int, n: int) -> bool:
        """False if there is no room for another content. One content, or contents of one digest, always have
        room: no hash of the digest would part them."""
        slot = self.slots.get(content)
        if slot is None:
            need = len(content) + SLOT
            if self.used + need > self.room and self.slots and self.digests != {digest}:
                return False
            self.slots[content] = [digest, keep, ties, n]
            self.digests.add(digest)
            self.used += need
            return True
        if slot[1] == keep:
            slot[2] += ties
        elif slot[1] is None or (keep is not None and keep > slot[1]):
            slot[1], slot[2] = keep, ties
        slot[3] += n
        return True

    def records(self):
        for content, (digest, keep, ties, n) in self.slots.items():
            yield digest, content, keep, ties, n

    def groups(self):
        """Groups of two rows and more; with their content where another one has the same digest."""
        shared = Counter(s[0] for s in self.slots.values()) if len(self.digests) < len(self.slots) else {}
        for content, (digest, keep, ties, n) in self.slots.items():
            if n > 1:
                yield digest, content if shared.get(digest, 1) > 1 else None, keep, ties, n


def _batches(records, spilled: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for record in records:
        rows.append((*record, spilled))
        held += len(record[1] or b"")
        if len(rows) >= ROWS or held >= BYTES:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD)], schema=RECORD)


def _read(batches: Iterator[pa.RecordBatch]):
    names = RECORD.names[:5]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))


def _combine(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """Merges the copies that one task meets; a full table is passed on and begun anew."""
    table = Table(room)
    for record in _read(batches):
        if not table.add(*record):
            yield from _batches(table.records(), False)
            table = Table(room)
            table.add(*record)
    yield from _batches(table.records(), False)


def _resolve(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """One bucket -> its groups, or spill records for the next level if it does not fit."""
    table, records = Table(room), _read(batches)
    for record in records:
        if not table.add(*record):
            yield from _batches(table.records(), True)
            table = None
            yield from _batches([record], True)
            yield from _batches(records, True)
            return
    yield from _batches(table.groups(), False)


def groups(records: DataFrame, room: int = ROOM) -> DataFrame:
    """Records (digest, content, keep_id, ties, n) -> a row for each content that n sums to two or more for:
    digest, keep_id, ties (rows of that doc_id), n, and the content where its digest is not its own."""
    spark = records.sparkSession
    fan_out = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets, found, level = fan_out, None, 0
    while True:
        merged = records.mapInArrow(partial(_combine, room=room), _SCHEMA)
        dealt = merged.repartition(buckets, F.xxhash64(F.lit(level), "digest"))
        done = cut(dealt.mapInArrow(partial(_resolve, room=room), _SCHEMA), f"grace{level}")
        whole = done.where("not spilled").drop("spilled")
        found = whole if found is None else found.unionAll(whole)
        records = done.where("spilled")
        size = records.agg(F.sum(F.length("content") + SLOT)).first()[0]
        if not size:
            return found
        # So many buckets that a quarter of a table is filled on average, within the fan-out of each bucket.
        buckets, level = max(2, min(4 * size // room + 1, buckets * fan_out)), level + 1


def deduplicate(docs: DataFrame, carry: tuple[str, ...] = (), *, room: int = ROOM, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; with carry, the struct `row`
    of those columns of docs too.

    Texts are equal when identical, null counts as empty. Of equal texts the row with the largest doc_id
    stays (a null id is the smallest); of rows that repeat it, one. An empty table gives an empty result;
    further columns do not clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"), *packed)
    records = rows.select("digest", F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("ties"), F.lit(1).cast("long").alias("n"))
    found = cut(groups(records, room).withColumnsRenamed({"digest": "d", "content": "c"}), "groups")
    own = ["doc_id", F.sha2("text", 256).alias("text_sha256"), *(["row"] if carry else [])]

    # Contents that share a digest: matched by the content (with SHA-256 there are none).
    twins = found.where("c is not null")
    if twins.isEmpty():
        key = lambda a, b: a["digest"] == b["d"]
    else:
        key = lambda a, b: (a["digest"] == b["d"]) & (b["c"].isNull() | (a["text"].cast("binary") == b["c"]))

    total = docs.count()
    hot, rest = found.where(F.col("n") * HOT > total), found.where(F.col("n") * HOT <= total)
    first = rows.join(F.broadcast(hot), key(rows, hot), "left")
    in_hot = first.where("d is not null")
    others = first.where("d is null").drop(*found.columns)
    every = in_hot.select(*own, "d", "keep_id", "ties", "n").unionAll(join_checked(others, rest, key(others, rest), "left").select(*own, "d", "keep_id", "ties", "n"))
    on_top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    carried = ["row"] if carry else []
    result = lambda kept: ["doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", *carried]
    if found.where("ties > 1").isEmpty():
        return every.select(*result(F.col("n").isNull() | on_top))

    # Rows that repeat the id that stays: numbered in a written table, the lowest number stays.
    tied = F.coalesce(F.col("ties") > 1, F.lit(False)) & on_top
    numbered = cut(every.where(tied).withColumn("number", F.monotonically_increasing_id()), "tied")
    lowest = cut(numbered.groupBy(F.col("text_sha256").alias("of"), F.col("keep_id").alias("kept_id"), F.col("n").alias("size")).agg(F.min("number").alias("lowest")), "lowest").select("lowest")
    one = join_checked(numbered, lowest, F.col("number") == F.col("lowest"), "left")
    return every.where(~tied).select(*result(F.col("n").isNull() | on_top)).unionAll(one.select(*result(F.col("lowest").isNotNull())))


def distinct_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return deduplicate(docs, tuple(docs.columns)).where("kept").select("row.*")


def query(spark, sf_dir):
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
"""
