"""Near-duplicate embeddings by random-hyperplane sign hashing.

Copies of a vector under one label form a class with a number of its own. Each class is hashed by the
signs of its products with random hyperplanes, `bits` signs to a table, in several tables. `bits` grows
with the logarithm of the largest label, so that buckets keep a few hundred vectors, and the number of
tables follows from it so that a pair right at the threshold is missed with probability MISS at most.

Two passes over the buckets. The first sees sign codes of CODE bits alone: it finds the vectors that
have a mate within a Hamming distance which no linked pair exceeds in practice (six standard
deviations beyond the threshold's expectation). Only those are sent on with their vectors, and the
second pass compares them by exact cosine in double precision, as blocked matrix products. A pair that
meets in several tables counts only in the first, so links need no list of pairs: a task returns for
each vector its number of links and its smallest local mate. Buckets beyond BLOCK rows are dealt out as
block pairs; none is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scratch import cut, join_checked
from graphloom.llm.blocks import local_roots
from graphloom.llm.vectors import finite, nonzero
from graphloom.operators.components import components

MISS = 1e-6
BUCKET = 256
BLOCK = 2048
#: Signs that travel with an entry.
CODE = 256


def plan_tables(largest: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for the number of vectors under the largest label."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(32, max(1, math.ceil(math.log2(max(1, largest) / BUCKET))))
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-(agree**bits))))


def farthest(threshold: float) -> int:
    """Unlike signs among CODE that a linked pair can have: six standard deviations beyond the mean."""
    p = math.acos(threshold) / math.pi
    return math.ceil(CODE * p + 6 * math.sqrt(CODE * p * (1 - p)))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def _signs(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Signs of the products with the hyperplanes of this length: those of the tables, CODE at least."""
    dim = unit.shape[1]
    planes = np.random.Generator(np.random.PCG64(dim + 17)).standard_normal((max(CODE, bits * tables), dim))
    return unit @ planes.T >= 0


def _table_codes(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return (signs[:, : bits * tables].reshape(len(signs), tables, bits) * weight).sum(axis=2).astype(np.uint32)


def _codes(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Rows (c, grp, embedding) -> with the bucket of every table and the code."""
    for batch in batches:
        vectors = batch.column(2)
        sizes = np.diff(vectors.offsets.to_numpy())
        codes = np.zeros((batch.num_rows, tables), np.int64)
        short = np.zeros((batch.num_rows, CODE // 8), np.uint8)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            signs = _signs(_unit(vectors.take(pa.array(at)), int(dim)), bits, tables)
            codes[at] = _table_codes(signs, bits, tables)
            short[at] = np.packbits(signs[:, :CODE], axis=1, bitorder="little")
        buckets = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), pa.array(codes.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), buckets, pa.array([x.tobytes() for x in short], pa.binary())], names=["c", "grp", "buckets", "code"])


def _sides(key, group: pa.Table) -> list[pa.Table]:
    """The one or two blocks of a block pair; none where a side is missing."""
    side = group["side"].to_numpy()
    left = group.filter(pa.array(side == 0)).combine_chunks()
    right = left if key["lo"] == key["hi"] else group.filter(pa.array(side == 1)).combine_chunks()
    return [left, right] if left.num_rows and right.num_rows else []


def _earlier(left: np.ndarray, right: np.ndarray, upto: int, linked: np.ndarray) -> np.ndarray:
    """Without the pairs that meet in one of the first tables."""
    for t in range(upto):
        if not linked.any():
            break
        linked &= left[:, t][:, None] != right[:, t][None, :]
    return linked


def _survivors(names, values, group: pa.Table, most: int, bits: int) -> pa.Table:
    """One bucket (or block pair of it): members with a mate near enough by code, whom they meet here first."""
    key = dict(zip(names, (v.as_py() for v in values)))
    out = {n: [] for n in ("side", "c")}
    if sides := _sides(key, group):
        words, early = [], []
        known = min(key["tab"], CODE // bits)
        for t in sides:
            raw = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
            words.append(raw.view("<u8"))
            early.append(_table_codes(np.unpackbits(raw, axis=1, bitorder="little"), bits, known) if known else None)
        apart = np.zeros((len(words[0]), len(words[1])), np.uint16)
        for w in range(CODE // 64):
            apart += np.bitwise_count(words[0][:, w][:, None] ^ words[1][:, w][None, :])
        near = apart <= most
        if key["lo"] == key["hi"]:
            np.fill_diagonal(near, False)
        near = _earlier(early[0], early[1], known, near)
        for number, axis in ((0, 1), (1, 0)) if key["lo"] != key["hi"] else ((0, 1),):
            ids = sides[number]["c"].to_numpy()[near.any(axis=axis)]
            out["c"].append(ids)
            out["side"].append(np.full(len(ids), number, np.int32))
    n = sum(map(len, out["c"]))
    fixed = {k: pa.array([v] * n, pa.int64()) for k, v in key.items()}
    return pa.table(fixed | {"side": np.concatenate([np.empty(0, np.int32), *out["side"]]), "c": np.concatenate([np.empty(0, np.int64), *out["c"]])})


def _compare(names, values, group: pa.Table, threshold: float, bits: int, tables: int) -> pa.Table:
    """One bucket (or block pair of it) with vectors: links of each class and its smallest local mate."""
    key = dict(zip(names, (v.as_py() for v in values)))
    out = [(np.empty(0, np.int64),) * 3]
    if sides := _sides(key, group):
        units = [_unit(t["embedding"].combine_chunks(), key["dim"]) for t in sides]
        linked = units[0] @ units[1].T >= threshold
        if key["lo"] == key["hi"]:
            np.fill_diagonal(linked, False)
        if key["tab"] and linked.any():
            linked = _earlier(*(_table_codes(_signs(u, bits, tables), bits, tables) for u in units), key["tab"], linked)
        rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if len(rows):
            linked = linked[np.ix_(rows, cols)]
            (ids, own), (mates, other) = [(t["c"].to_numpy()[at], t["copies"].to_numpy()[at]) for t, at in zip(sides, (rows, cols))]
            low_r, low_c = local_roots(linked, ids, mates)
            out.append((ids, linked @ other, low_r))
            if key["lo"] != key["hi"]:
                out.append((mates, own @ linked, low_c))
    return pa.table({n: pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k, n in enumerate(("c", "links", "mate"))})


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Links between vectors of equal label with cosine >= threshold, and their components.

    Returns one row per input row: vec_id, n_links (other rows linked directly), component_id
    (smallest vec_id reachable), kept (vec_id = component_id). Vectors of different length never
    link. Rows whose label or vector is null, or whose vector is empty, all zero or not finite, link
    with nothing. Rows with a null vec_id take no part: 0 links, null component, kept. Rows that
    repeat a vec_id are vectors of their own: each counts as a link of its mates, and has the links and
    the component of its own label and vector. An empty table gives an empty result. Other columns
    are ignored.
    """
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")) & nonzero(F.col("embedding"))
    hashed_name = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", usable.alias("usable"), *hashed_name)
    classes = cut(
        rows.where("usable").groupBy("label", "h1", "h2")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        .select("label", "h1", "h2", "first", "copies", "embedding", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("c"))
        .withColumn("grp", F.xxhash64("label", "dim")),
        "classes",
    )
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold)
    most = farthest(threshold)
    hashed = cut(classes.select("c", "grp", "embedding").mapInArrow(partial(_codes, bits=bits, tables=tables), "c long, grp long, buckets array<long>, code binary"), "hashed")
    entries = hashed.select("grp", F.posexplode("buckets").alias("tab", "bucket"), "c", "code")
    spot = ["grp", "tab", "bucket"]
    hot = cut(
        entries.groupBy(*spot).count().where(F.col("count") > BLOCK)
        .select(*spot, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")),
        "hot",
    )
    dealt = join_checked(entries, hot, spot, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = [*spot, "lo", "hi"]
    dealt = dealt.select(
        *spot,
        F.least("block", "mate").alias("lo"),
        F.greatest("block", "mate").alias("hi"),
        F.when(F.col("block") <= F.col("mate"), 0).otherwise(1).alias("side"),
        "c", "code",
    ).repartition(*place)  # a shuffled join above would else keep a bucket's blocks together
    near = cut(
        dealt.groupBy(*place).applyInArrow(
            lambda key, t: _survivors(place, key, t, most, bits), "grp long, tab long, bucket long, lo long, hi long, side int, c long"
        ),
        "near",
    )
    # The labels themselves are part of the key here, so equal hashes of labels part again.
    where = ["label", "dim", *place]
    partial_links = cut(
        near.join(classes.select("c", "label", "dim", "embedding", "copies"), "c").repartition(*where).groupBy(*where)
        .applyInArrow(lambda key, t: _compare(where, key, t, threshold, bits, tables), "c long, links long, mate long"),
        "links",
    )
    counted = partial_links.groupBy("c").agg(F.sum("links").alias("links"))
    joined = components(partial_links, "c", "mate")
    every = cut(
        classes.select("c", "label", "h1", "h2", "first", "copies").join(counted, "c", "left").join(joined, F.col("c") == F.col("node"), "left")
        .select("label", "h1", "h2", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "c").alias("component")),
        "every",
    )
    lowest = every.groupBy("component").agg(F.min("first").alias("component_id"))
    found = every.join(lowest, "component").select(F.col("label").alias("of"), F.col("h1").alias("of1"), F.col("h2").alias("of2"), "links", "component_id")
    return (
        rows.drop("embedding").join(found, F.col("usable") & (F.col("label") == F.col("of")) & (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")), "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
        )
    )


def query(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN m ON m.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
