"""MinHash near-duplicates of documents with an LSH forest.

Method. Documents with one shingle set form a class. Every class stands in TREES sorted orders
(trees), each by its own ORDER minhashes. Inside a sorted partition the longest common prefixes of
neighbours give the regions of the forest: a row starts from its deepest prefix and widens to shorter
ones while the region stays at or below REGION rows, so a sparse part of the order is compared at
depth 1 or 2 and a dense one at 6 or 8. All pairs of a region are held against sketches. What passes
comes out as neighbours (the next row of the order, the one with the longest common prefix) and as a
forest over the region, never as a list of its pairs.

Neighbours are confirmed on full shingle sets and joined to components; then each tree of the forest
is compared across these components on full sets, in blocks, so that neighbours alone decide nothing.

The exact way for the rest: where more than REGION rows share a prefix of FLOOR minhashes, or a
partition's edge cuts such a region, depths beyond FLOOR could part a pair. Those rows are dealt out
once more by their prefix of FLOOR and compared across components, in blocks of any number. A pair of
Jaccard similarity s thus meets in one tree at least with probability 1 - (1 - s**FLOOR)**TREES:
0.999997 at s = 0.8, more where regions are wider. No region, cluster or list of candidates is capped.

Before full sets are compared, pairs are dropped whose sketch (SKETCH minhashes of four bits) estimates
less than five standard deviations under the threshold, 0.62 for 0.8; `estimates=False` compares all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scratch import cut, join_checked
from graphloom.llm.blocks import local_roots
from graphloom.llm.texts import WordHashes, byte_texts, mix, small_batches
from graphloom.operators.components import components, spanning_stars

TREES = 24
#: Minhashes of an order, two bytes each; and the depth at which regions of any size are compared.
ORDER = 8
FLOOR = 4
#: Rows of a region that are compared where they stand in the order.
REGION = 64
#: Rows of an order worked on at once.
CHUNK = 16_384
SKETCH = 128
#: Rows of one region or cluster compared in one task; larger ones are dealt out in blocks.
BLOCK = 2048
#: Shingles of a block, for very long texts.
BLOCK_SHINGLES = 2_000_000

def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles. Words are runs of bytes other than
    space and tab to carriage return; A-Z count as a-z. Fewer words than width: one shingle of all."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = hashes.of(words)
    with np.errstate(over="ignore"):
        width = min(width, len(ids))
        rolled = np.full(len(ids) - width + 1, width, np.uint64)
        for k in range(width):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(rolled)])
    return np.unique(rolled)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240501))
    odd = rng.integers(0, 2**31, SKETCH, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 2**32, SKETCH, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray, odd: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """SKETCH minhashes of a set of hashes."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        part = (low[None, at : at + 512] ^ flip[:, None]) * odd[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, text) -> with size and digest of the set, its place in every order, and its sketch."""
    hashes, (odd, flip) = WordHashes(), _coefficients()
    # FLOOR minhashes of its own for every tree, then those of the next one.
    picks = (np.arange(TREES)[:, None] * FLOOR + np.arange(ORDER)[None]) % SKETCH
    for batch in small_batches(batches):
        sizes, digests, orders, sketches = [], [], [], []
        for text in byte_texts(batch.column(2)):
            shingles = shingle_set(text, width, hashes)
            sizes.append(len(shingles))
            if not len(shingles):
                for column in (digests, orders, sketches):
                    column.append(None)
                continue
            signed = signature(shingles, odd, flip)
            digests.append(_digest(shingles))
            orders.append((signed[picks] & 0xFFFF).astype(">u2").tobytes())
            bits = ((signed >> np.uint32(16)) & 15).astype(np.uint8)
            sketches.append((bits[0::2] << 4 | bits[1::2]).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, orders, sketches))],
            names=["doc_id", "key", "n_shingles", "digest", "orders", "sketch"],
        )


def _fixed(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.empty((0, 0), kind)
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(flat), -1).view(kind)


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from sketches as 64-bit words: equal four-bit minhashes, corrected for chance."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    unlike = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int32)
    return ((SKETCH - unlike) / SKETCH - 1 / 16) * (16 / 15)


def least_estimate(percent: int) -> float:
    """Five standard deviations of the estimate under the threshold."""
    s = percent / 100
    p = s + (1 - s) / 16
    return s - 5 * math.sqrt(p * (1 - p) / SKETCH) * 16 / 15


def _near_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The larger of two sets can be at most 100 / percent times the smaller."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def region_depths(same: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix lengths of neighbours in a sorted order -> (depth, region) of every row: from the
    deepest prefix the region widens while it has at most `most` rows. Depth 0: even the deepest prefix
    is shared by more; such rows are regions of their own."""
    n = len(same) + 1
    depth, region = np.zeros(n, np.int64), np.arange(n)
    for d in range(ORDER, 0, -1):
        starts = np.flatnonzero(np.append(True, same < d))
        sizes = np.diff(np.append(starts, n))
        fits = np.repeat(sizes <= most, sizes)
        depth[fits], region[fits] = d, np.repeat(starts, sizes)[fits]
    return depth, region


def _chunk(rows: list[np.ndarray], percent: int, estimates: bool, most: int, cut_first: bool, cut_last: bool) -> list[np.ndarray]:
    """A stretch of an order -> rows of (kind, a, b): 0 neighbours that may link, 1 a forest of what may
    link in a region, 2 (region of FLOOR, class) where a region is open."""
    tree, order, node, size, sketch = rows
    n = len(node)
    same = ((order[1:] == order[:-1]) & (tree[1:] == tree[:-1])[:, None]).cumprod(axis=1).sum(axis=1)
    depth, region = region_depths(same, most)
    found = []
    for step in range(1, most):
        i = np.flatnonzero(region[step:] == region[:-step]) if step < n else np.empty(0, int)
        if not len(i):
            break
        i = i[_near_sizes(size[i], size[i + step], percent)]
        if estimates:
            i = i[_estimates(sketch[i], sketch[i + step]) >= least_estimate(percent)]
        found.append((i, i + step))
    out = []
    # Neighbours may also share a prefix that many share.
    i = np.flatnonzero(same > 0)
    i = i[_near_sizes(size[i], size[i + 1], percent)]
    if estimates:
        i = i[_estimates(sketch[i], sketch[i + 1]) >= least_estimate(percent)]
    out.append((0, np.minimum(node[i], node[i + 1]), np.maximum(node[i], node[i + 1])))
    if found:
        a, b = (np.concatenate(x) for x in zip(*found))
        low, high = spanning_stars(a, b)
        out.append((1, node[low], node[high]))
    open_rows = (depth > FLOOR) | (depth == 0)
    edges = np.flatnonzero(same < FLOOR)
    if cut_first:
        open_rows[: edges[0] + 1 if len(edges) else n] = True
    if cut_last:
        open_rows[edges[-1] + 1 if len(edges) else 0 :] = True
    if open_rows.any():
        key = tree[open_rows].astype(np.uint64) + np.uint64(1)
        for k in range(FLOOR):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + order[open_rows, k].astype(np.uint64))
        out.append((2, key.astype(np.int64), node[open_rows]))
    return out


def _forest(batches: Iterator[pa.RecordBatch], percent: int, estimates: bool, most: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """The sorted orders of one partition (tree, order, c, n, sketch), a chunk at a time. Chunks end
    between regions of FLOOR; where one region fills a chunk, and at both ends of the partition, the
    region counts as open."""
    held, cut_first = None, True

    def result(parts):
        kinds, a, b = (np.concatenate(x) for x in zip(*[(np.full(len(p[1]), p[0], np.int8), p[1], p[2]) for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = [
            batch.column(0).to_numpy(zero_copy_only=False), _fixed(batch.column(1), ">u2").astype(np.uint16), batch.column(2).to_numpy(zero_copy_only=False),
            batch.column(3).to_numpy(zero_copy_only=False), _fixed(batch.column(4), "<u8"),
        ]
        held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
        if len(held[0]) < chunk:
            continue
        tree, order = held[0], held[1]
        breaks = np.flatnonzero((order[1:, :FLOOR] != order[:-1, :FLOOR]).any(axis=1) | (tree[1:] != tree[:-1]))
        upto = breaks[-1] + 1 if len(breaks) else len(tree)
        yield result(_chunk([x[:upto] for x in held], percent, estimates, most, cut_first, not len(breaks)))
        held, cut_first = ([x[upto:] for x in held], False) if len(breaks) else (None, True)
    if held is not None:
        yield result(_chunk(held, percent, estimates, most, cut_first, True))


def _sides(key, group: pa.Table) -> tuple[pa.Table, pa.Table]:
    left = group.filter(group["side"].to_numpy() == 0).combine_chunks()
    return left, left if key[1] == key[2] else group.filter(group["side"].to_numpy() == 1).combine_chunks()


def _unlike(left: pa.Table, right: pa.Table, percent: int, estimates: bool) -> np.ndarray:
    """Which pairs of two blocks lie in different components and pass sizes and sketches."""
    (na, ca, sa), (nb, cb, sb) = [(t["n"].to_numpy(), t["comp"].to_numpy(), _fixed(t["sketch"], "<u8")) for t in (left, right)]
    linked = np.zeros((len(na), len(nb)), bool)
    for i in range(len(na)):
        near = np.flatnonzero((cb != ca[i]) & _near_sizes(nb, na[i], percent))
        if len(near):
            linked[i, near[_estimates(sb[near], sa[i]) >= least_estimate(percent)] if estimates else near] = True
    return linked


def _block_forest(linked: np.ndarray, left: pa.Table, right: pa.Table) -> pa.Table:
    """One row for each linked member: the member and the smallest it reaches here."""
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    a, b = left["c"].to_numpy()[rows], right["c"].to_numpy()[cols]
    low_a, low_b = local_roots(linked[np.ix_(rows, cols)], a, b)
    return pa.table({"a": np.concatenate([a, b]), "b": np.concatenate([low_a, low_b])})


def _likely(key, group: pa.Table, percent: int, estimates: bool) -> pa.Table:
    """One block pair of a region -> which members may link across components, as a forest."""
    left, right = _sides(key, group)
    return _block_forest(_unlike(left, right, percent, estimates), left, right)


def _across(key, group: pa.Table, percent: int, estimates: bool) -> pa.Table:
    """One block pair of a cluster -> its links across components, confirmed on full sets, as a forest."""
    left, right = _sides(key, group)
    linked = _unlike(left, right, percent, estimates)
    sets = [np.frombuffer(x, np.uint64) for t in (left, right) for x in t["shingles"].to_pylist()]
    sizes = np.array([len(x) for x in sets])
    # Shingles by their place in the block, so that one row is held against all others at once.
    names, places = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.empty(0), np.empty(0, int))
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(names), np.int32)
    at = left.num_rows
    for i in np.flatnonzero(linked.any(axis=1)):
        own = places[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[places[starts[at] :]], starts[at:] - starts[at])
        mark[own] = 0
        linked[i] &= 100 * shared >= percent * (sizes[at:] + sizes[i] - shared)
    return _block_forest(linked, left, right)


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (c, digest, text) -> (c, shingles) where the text has the digest's set."""
    hashes = WordHashes()
    for batch in small_batches(batches, 200):
        sets = [shingle_set(text, width, hashes) for text in byte_texts(batch.column(2))]
        right = [_digest(x) == d for x, d in zip(sets, batch.column(1).to_pylist())]
        made = pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["c", "shingles"])
        yield made.filter(pa.array(right, pa.bool_()))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 500):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """c, shingles of the wanted classes, from the whole text of each class's first document."""
    firsts = cut(classes.join(wanted, "c").select("c", "first", "digest"), "firsts")
    texts = join_checked(docs, firsts, docs["doc_id"] == firsts["first"]).select("c", "digest", "text")
    return cut(texts.mapInArrow(partial(_full_sets, width=width), "c long, shingles binary").dropDuplicates(["c"]), "sets")


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of classes that hold on full shingle sets."""
    sets = _sets_of(docs, cut(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "ends"), classes, width)
    sided = (
        pairs.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return cut(sided.mapInArrow(partial(_confirm, percent=percent), "a long, b long").distinct(), "links")


def _block_pairs(members: DataFrame, *carried: str) -> DataFrame:
    """Deals the members (region, c, n, sketch, comp and what is carried) of regions with several
    components to block pairs. The region's largest component is never compared with itself, so only
    the others are repeated against its blocks: work and copies follow (others x all), not all x all."""
    per = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    regions = per.groupBy("region").agg(
        F.count(F.lit(1)).alias("comps"), F.max(F.struct("m", "s", "comp")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s")
    )
    blocks = lambda m, s: F.ceil(F.greatest(m / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    regions = regions.where("comps > 1").select(
        "region",
        F.col("top.comp").alias("top"),
        blocks(F.col("top.m"), F.col("top.s")).alias("top_blocks"),
        blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("rest_blocks"),
    )
    dealt = members.join(regions, "region").withColumn("in_top", F.col("comp") == F.col("top"))
    # Blocks 0..rest-1 hold the other components, rest.. the largest one.
    dealt = dealt.withColumn(
        "block",
        F.when(F.col("in_top"), F.col("rest_blocks") + F.pmod(F.xxhash64("c"), F.col("top_blocks")))
        .otherwise(F.pmod(F.xxhash64("c"), F.col("rest_blocks")))
        .cast("int"),
    )
    rest = F.sequence(F.lit(0), F.col("rest_blocks") - 1)
    every = F.sequence(F.lit(0), F.col("rest_blocks") + F.col("top_blocks") - 1)
    mates = F.when(F.col("in_top"), rest).otherwise(every)
    return dealt.withColumn("mate", F.explode(mates)).select(
        "region",
        F.least("block", "mate").alias("lo"),
        F.greatest("block", "mate").alias("hi"),
        F.when(F.col("block") <= F.col("mate"), 0).otherwise(1).alias("side"),
        "c", "n", "sketch", "comp", *carried,
    ).repartition("region", "lo", "hi")  # else the join's dealing by region would keep its blocks together


def _components(docs: DataFrame, width: int, percent: int, estimates: bool) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, key, text) -> (doc_id, key, n_shingles, digest) of every row and (digest,
    component, component_id) of every class; the component is the number of one of its classes, the
    component_id its smallest doc_id."""
    schema = "doc_id long, key long, n_shingles long, digest binary, orders binary, sketch binary"
    sketched = cut(docs.select("doc_id", "key", "text").mapInArrow(partial(_sketch, width=width), schema), "sketched")
    # Rows of one set form a class; all of them have the same orders and sketch.
    classes = cut(
        sketched.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("orders").alias("orders"), F.first("sketch").alias("sketch"))
        .withColumn("c", F.monotonically_increasing_id()),
        "classes",
    )
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    entries = classes.select(tree.alias("tree"), "orders", "c", "n", "sketch").select(
        "tree", F.substring("orders", F.col("tree") * (2 * ORDER) + 1, F.lit(2 * ORDER)).alias("order"), "c", "n", "sketch"
    )
    forest = cut(
        entries.repartitionByRange("tree", "order", "c").sortWithinPartitions("tree", "order", "c")
        .mapInArrow(partial(_forest, percent=percent, estimates=estimates, most=REGION, chunk=CHUNK), "kind byte, a long, b long").distinct(),
        "forest",
    )
    first = _links(docs, forest.where("kind = 0").select("a", "b"), classes, width, percent)
    joined = cut(components(first, "a", "b"), "joined").select(F.col("node").alias("c"), "component")

    # Open regions: all pairs across components.
    opened = forest.where("kind = 2").select(F.col("a").alias("region"), F.col("b").alias("c"))
    crowded = opened.groupBy("region").count().where("count > 1").select("region")
    placed = (
        opened.join(crowded, "region", "left_semi").join(classes.select("c", "n", "sketch"), "c").join(joined, "c", "left")
        .select("region", "c", "n", "sketch", F.coalesce("component", "c").alias("comp"))
    )
    likely = (
        _block_pairs(cut(placed, "placed")).groupBy("region", "lo", "hi")
        .applyInArrow(lambda key, t: _likely(key, t, percent, estimates), "a long, b long")
    )
    # What may link, wherever it was found, forms clusters; each is confirmed across components.
    either = cut(forest.where("kind = 1").select("a", "b").unionAll(likely), "likely")
    clusters = components(either, "a", "b").select(F.col("node").alias("c"), F.col("component").alias("region"))
    clusters = clusters.join(joined, "c", "left").select("region", "c", F.coalesce("component", "c").alias("comp"))
    clusters = cut(clusters, "clusters")
    mixed = clusters.groupBy("region").agg(F.countDistinct("comp").alias("comps")).where("comps > 1").select("region")
    clusters = cut(clusters.join(mixed, "region", "left_semi"), "mixed")
    sets = _sets_of(docs, clusters.select("c"), classes, width)
    clustered = clusters.join(sets, "c").join(classes.select("c", "n", "sketch"), "c")
    second = (
        _block_pairs(cut(clustered, "clustered"), "shingles").groupBy("region", "lo", "hi")
        .applyInArrow(lambda key, t: _across(key, t, percent, estimates), "a long, b long")
    )
    component = cut(components(first.unionAll(second), "a", "b"), "component")
    every = classes.select("c", "digest", "first").join(component, F.col("c") == F.col("node"), "left")
    every = cut(every.select("digest", "first", F.coalesce("component", "c").alias("component")), "every")
    lowest = every.groupBy("component").agg(F.min("first").alias("component_id"))
    return sketched.select("doc_id", "key", "n_shingles", "digest"), cut(every.join(lowest, "component").select("digest", "component", "component_id"), "classed")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, *, estimates: bool = True) -> DataFrame:
    """Components of documents linked at 100 * |A and B| >= percent * |A or B| over word shingles.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable),
    kept (doc_id = component_id). Texts that are null, empty or blank have no shingles and link with
    nothing. Rows with a null doc_id take no part: their component is null and they are kept. Rows
    that repeat a doc_id are documents of their own, linked by their texts alone. An empty table gives
    an empty result. Further columns of docs are ignored.
    """
    rows, classed = _components(_keyed(docs), width, percent, estimates)
    classed = classed.select(F.col("digest").alias("of"), "component_id")
    found = rows.join(classed, (F.col("digest") == F.col("of")) & F.col("doc_id").isNotNull(), "left")
    return found.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, *, estimates: bool = True) -> DataFrame:
    """docs with one row of each near-duplicate component: the smallest doc_id, of its rows one.

    Decided by row, not by id: a doc_id that is repeated with another text keeps that text unless it
    is a near copy itself, and of rows repeated in full one stays. Rows without shingles or with a null
    doc_id all stay. All columns pass through.
    """
    rows, classed = _components(_keyed(docs), width, percent, estimates)
    per = rows.where("digest is not null and doc_id is not null").groupBy("doc_id", "key", "digest").agg(F.count(F.lit(1)).alias("times"))
    per = cut(per.join(classed, "digest").select("doc_id", "key", "times", "component"), "per")
    chosen = per.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("stays"))
    judged = per.join(chosen, "component").withColumn("stays", F.struct("doc_id", "key") == F.col("stays"))
    touched = cut(judged.where("not stays or times > 1").select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "stays"), "touched")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    on = lambda t: (row["id"] == t["of"]) & (row["key"] == t["of_key"])
    rest = join_checked(row, touched, on(touched), "left_anti").select("row.*")
    repeated = touched.where("stays")
    once = join_checked(row, repeated, on(repeated)).dropDuplicates(["id", "key"]).select("row.*")
    return rest.unionAll(once)


def query(spark, sf_dir):
    """All documents, two-word shingles, similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
    AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN m ON m.a = s.doc_id
"""
