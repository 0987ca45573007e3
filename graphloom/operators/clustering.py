"""Clustering, projection and cluster geometry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut, discard, join_checked, mark
from graphloom.operators.components import components
from graphloom.operators.similarity import BLOCK, dot, doubles, squared_distance


def projection_weights(dims: int, axis: int) -> list[float]:
    """A fixed pseudo-random direction: signs from SHA-256 of the axis and dimension."""
    import hashlib

    return [1.0 if int(hashlib.sha256(f"{axis}-{i}".encode()).hexdigest()[:8], 16) % 2 else -1.0 for i in range(dims)]


def random_projection(points: DataFrame, dims: int, axes: int = 2) -> DataFrame:
    """(id, x, y, ...): products with fixed random directions, scaled by the root of their number."""
    names = "xyzuvw"[:axes]
    cols = [(dot(doubles(F.col("vec")), F.array(*map(F.lit, projection_weights(dims, a)))) / F.sqrt(F.lit(float(axes)))).alias(n) for a, n in enumerate(names)]
    return points.select("id", *cols, *[c for c in points.columns if c not in ("id", "vec")])


def in_box(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def lloyd(points: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """K-means from given seeds (cluster, centre) in a fixed number of steps over points (id, vec): each
    step broadcasts one row with the k centres, assigns each point where it lies and averages by dimension;
    only the means are shuffled. Ties go to the smaller cluster; a cluster that loses all points
    disappears. Returns id, cluster."""
    def assign(centres):
        every = centres.agg(F.collect_list(F.struct("cluster", "centre")).alias("centres"))
        at = lambda s: F.struct(squared_distance(F.col("vec"), s["centre"]).alias("d"), s["cluster"].alias("cluster"))
        return points.join(F.broadcast(every)).select("id", "vec", F.array_min(F.transform("centres", at))["cluster"].alias("cluster"))

    centres = seeds
    for _ in range(steps):
        means = assign(centres).select("cluster", F.posexplode(doubles(F.col("vec"))).alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("x"))
        centres = cut(means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centre")), "centres")
    return assign(centres).select("id", "cluster")


def neighbour_counts(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n): neighbours of each id in symmetric pairs (a, b), the id itself included."""
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b"))
    return ids.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("n"))


def dbscan(ids: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """DBSCAN over the pairs (a, b) within eps: cores have at least `least` points within eps, themselves
    included; clusters are the connected components of cores and are named by their smallest core; a
    border point joins the cluster of its smallest neighbouring core; the rest is noise, -1."""
    core = neighbour_counts(pairs, ids).where(F.col("n") >= least).select("id")
    both = pairs.select("a", "b").unionAll(pairs.select("b", "a"))
    a, b = core.select(F.col("id").alias("a")), core.select(F.col("id").alias("b"))
    linked = pairs.select("a", "b").join(a, "a", "left_semi").join(b, "b", "left_semi")
    named = core.join(components(linked, "a", "b").withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = both.join(core.withColumnRenamed("id", "b"), "b", "left_semi").join(core.withColumnRenamed("id", "a"), "a", "left_anti")
    border = border.groupBy("a").agg(F.min("b").alias("b")).join(named.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "cluster")
    return ids.join(named.unionByName(border), "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def _apart(a: str, b: str) -> Column:
    """The squared distance of two points, from columns that begin with a and b."""
    return (F.col(f"{a}x") - F.col(f"{b}x")) ** 2 + (F.col(f"{a}y") - F.col(f"{b}y")) ** 2


def dbscan_plane(points: DataFrame, eps: float, least: int) -> DataFrame:
    """dbscan() of points (id, x, y) without a list of the pairs within eps, which grows with the square of a cell.

    Two points of a cell are within eps of each other, so those of a cell of `least` points are cores, all in one cluster; only
    points of emptier cells are held against the cells around. Two cells of cores belong together where any two
    of their points are within eps: the outermost points in eight directions settle most, and only cells that are still in
    different components are searched. What is written grows with the points."""
    # The side leaves room for rounding, of coordinates up to a thousand million cells.
    side, most, reach = eps / 2**0.5 * (1 - 1e-6), eps * eps, range(-2, 3)
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    rows = cut(points.where(finite).select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).select("*", F.floor(F.col("x") / side).alias("i"), F.floor(F.col("y") / side).alias("j")), "placed")
    around = lambda df, steps: df.withColumn("_step", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("i"), F.lit(b).cast("long").alias("j")) for a, b in steps])))
    every = [(a, b) for a in reach for b in reach]
    # Rows of one id are one point.
    full = rows.groupBy("i", "j").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= least).select("i", "j")
    full = cut(full, "full")
    sparse = cut(rows.join(full, ["i", "j"], "left_anti"), "sparse")

    def met(some, others):
        asks = around(some.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("i").alias("ci"), F.col("j").alias("cj")), every)
        asks = asks.select("a", "ax", "ay", (F.col("ci") + F.col("_step.i")).alias("i"), (F.col("cj") + F.col("_step.j")).alias("j"))
        return asks.join(others, ["i", "j"]).where((F.col("a") != F.col("id")) & ((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 <= most))

    some = met(sparse, rows).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= least).select("id")
    cores = cut(rows.join(full, ["i", "j"], "left_semi").select("id").unionAll(some).distinct(), "cores")
    core = cut(rows.join(cores, "id", "left_semi"), "core")
    corner = F.struct("x", "y")
    outer = [f(corner, by) for by in (F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")) for f in (F.min_by, F.max_by)]
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    cells = cut(core.groupBy("i", "j").agg(F.min("id").alias("cell"), F.array_distinct(F.array(*outer)).alias("outer"), *box), "cells")
    columns = [c for c in cells.columns if c not in ("i", "j")]
    mine = cells.select("i", "j", *[F.col(c).alias(f"a_{c}") for c in columns])
    half = [(a, b) for a, b in every if a > 0 or (a == 0 and b > 0)]
    steps = around(mine.withColumnsRenamed({"i": "ai", "j": "aj"}), half).withColumns({"i": F.col("ai") + F.col("_step.i"), "j": F.col("aj") + F.col("_step.j")}).drop("_step")
    near = lambda p, q: (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 <= most
    pairs = steps.join(cells.select(F.col("i"), F.col("j"), *[F.col(c).alias(f"b_{c}") for c in columns]), ["i", "j"]).withColumnsRenamed({"i": "bi", "j": "bj"})
    pairs = cut(pairs.withColumn("linked", F.exists("a_outer", lambda p: F.exists("b_outer", lambda q: near(p, q)))).drop("a_outer", "b_outer"), "cell_pairs")
    links = pairs.where("linked").select("a_cell", "b_cell")
    if core.count() > cores.count():
        shared = core.join(cells.select("i", "j", "cell"), ["i", "j"]).select("id", "cell")
        links = links.unionAll(shared.join(shared.groupBy("id").agg(F.min("cell").alias("least")), "id").where("cell <> least").select("least", "cell"))
    links = cut(links, "links")
    found = cut(components(links, "a_cell", "b_cell"), "components")
    part = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    still = pairs.where("NOT linked").join(part("a_cell"), "a_cell", "left").join(part("b_cell"), "b_cell", "left")
    still = cut(still.where("coalesce(a_cell_part, a_cell) <> coalesce(b_cell_part, b_cell)"), "open")
    # Of either cell, the points that are within eps of the other's box.
    off = lambda c, end: F.greatest(F.col(f"{end}_{c}0") - F.col(c), F.col(c) - F.col(f"{end}_{c}1"), F.lit(0.0)) ** 2
    close = lambda end: off("x", end) + off("y", end) <= most * (1 + 1e-9)
    ends = []
    for end, other in (("a", "b"), ("b", "a")):
        there = still.join(core.withColumnsRenamed({"i": f"{end}i", "j": f"{end}j"}), [f"{end}i", f"{end}j"]).where(close(other))
        ends.append(there.select("a_cell", "b_cell", F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y")).distinct())
    more = ends[0].join(ends[1], ["a_cell", "b_cell"]).where(_apart("a", "b") <= most).select("a_cell", "b_cell").distinct()
    more = cut(more, "links")
    if not more.isEmpty():
        found = cut(components(links.unionAll(more), "a_cell", "b_cell"), "components")
    # A cell goes by its smallest core, so a component goes by the smallest of all.
    named = cells.join(found.withColumnRenamed("node", "cell"), "cell", "left").select("i", "j", F.coalesce("component", "cell").alias("cluster"))
    named = cut(core.join(named, ["i", "j"]), "named")
    edge = met(sparse.join(cores, "id", "left_anti"), named).groupBy("a").agg(F.min(F.struct("id", "cluster")).alias("of"))
    every = named.select("id", "cluster").distinct().unionAll(edge.select("a", "of.cluster"))
    return points.select("id").join(every, "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def _block_pairs(points: DataFrame, *columns: str) -> DataFrame:
    """Points (id, vec, ...) dealt so that each block of them meets each block once: as queries (is_query)
    and as the points they are held against. The number of blocks follows from one count."""
    n = max(1, -(-points.count() // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = points.select("id", doubles(F.col("vec")).alias("vec"), *columns, block.alias("block"))
    left = rows.select("id", "vec", *columns, F.col("block").alias("q"), every.alias("p"), F.lit(True).alias("is_query"))
    right = rows.select("id", "vec", *columns, every.alias("q"), F.col("block").alias("p"), F.lit(False).alias("is_query"))
    return left.unionByName(right).groupBy("q", "p")


#: Distances that are held at a time (8 bytes each).
HELD = 1 << 18


def _matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Lists of equal length as a matrix of doubles, without a Python object for each number."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1)


def _sliced(vectors: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of some vectors and their Euclidean distances to all others: slices of at most HELD distances (one row
    at least), so memory does not follow the square of a block."""
    points, rows = np.ascontiguousarray(others.T), max(1, HELD // len(others))
    for at in range(0, len(vectors), rows):
        some = np.arange(at, min(at + rows, len(vectors)))
        squares = np.zeros((len(some), len(others)))
        for k, values in enumerate(points):
            apart = vectors[some, k][:, None] - values[None, :]
            apart *= apart
            squares += apart
        yield some, np.sqrt(squares, out=squares)


def _distances(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of some queries and of all points of a block pair, and their Euclidean distances, in slices."""
    queries = table["is_query"].to_numpy(zero_copy_only=False).astype(bool)
    left, right = np.flatnonzero(queries), np.flatnonzero(~queries)
    if len(left) and len(right):
        vectors = _matrix(table["vec"])
        for some, d in _sliced(vectors[left], vectors[right]):
            yield left[some], right, d


#: Bytes of packed blocks that a task of across() is held against, and pairs of blocks that go to Python at a time.
SHARE, AT_A_TIME = 32_000_000, "4"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition as one row: its number, and a table in bytes."""
    from pyspark import TaskContext

    if not (rows := [b for b in batches if b.num_rows]):
        return
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema) as writer:
        writer.write_table(pa.Table.from_batches(rows).combine_chunks())
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])


def across(points: DataFrame, step: Callable[[int, pa.Table, Iterator[tuple[int, pa.Table]]], pa.Table], schema: str, some: DataFrame | None = None) -> DataFrame:
    """step(number, block, others) for each block of points (id, ...), or of some of them, and each share of all blocks, itself
    included. Rows of one id are in the block of one number. Each block is one row of bytes, and tasks read the shares from their files or from one exchange: points
    are moved and written a fixed number of times, not once for each block, and a task holds one share. Written at once."""
    spark, since = points.sparkSession, mark()
    n = max(1, -(-points.count() // BLOCK))
    packed = lambda df: cut(df.repartition(n, "id").mapInArrow(_pack, "block long, data binary"), "blocks")
    rows = packed(points)
    size = rows.agg(F.sum(F.length("data")), F.count(F.lit(1))).first()
    shares = max(1, -(-(size[0] or 0) // SHARE))
    others = rows.repartition(shares).select(F.col("block").alias("other"), F.col("data").alias("held"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda data: pa.ipc.open_stream(data.as_buffer()).read_all()
        pairs = (row for b in batches for row in zip(*(b.column(k) for k in range(4))))
        for block, some in groupby(pairs, key=lambda row: row[0].as_py()):
            first = next(some)
            yield from step(block, read(first[1]), ((r[2].as_py(), read(r[3])) for r in chain([first], some))).to_batches()

    asking, before = rows if some is None else packed(some), spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, AT_A_TIME)
    try:
        out = cut(asking.repartition(n).crossJoin(others.hint("shuffle_replicate_nl")).select("block", "data", "other", "held").mapInArrow(held, schema), "across")
    finally:
        spark.conf.set(_BATCH, before)
    discard(spark, since)
    return out


_NO_DISTANCES = pa.table({"id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})


def nearest_distances(points: DataFrame, k: int) -> DataFrame:
    """(id, distance) to the k-th nearest other point. A block pair returns the k best of each query."""

    def best(key, table):
        ids, found = table["id"].to_numpy(), [_NO_DISTANCES]
        for left, right, d in _distances(table):
            d[ids[left][:, None] == ids[right][None, :]] = np.inf
            if d.shape[1] > k:
                d = np.partition(d, k - 1, axis=1)[:, :k]
            keep = np.isfinite(d)
            found.append(pa.table({"id": np.repeat(ids[left], keep.sum(axis=1)), "distance": d[keep]}))
        return pa.concat_tables(found)

    near = _block_pairs(points).applyInArrow(best, "id long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance"))
    return near.withColumn("_k", rank).where(F.col("_k") == k).select("id", "distance")


_SUMS = pa.schema([("id", pa.int64()), ("k", pa.int32()), ("cluster", pa.int64()), ("oc", pa.int64()), ("total", pa.float64()), ("n", pa.float64())])


#: Clusters, of all places together, up to which a row of silhouettes() has a sum for each.
MEMBERS = 1024


def silhouettes(points: DataFrame) -> DataFrame:
    """(k, silhouette) for each place k, from 0, of the clusters of points (id, clusters, vec): mean silhouettes
    (Euclidean) of several clusterings of the same points; null with fewer than two clusters. Distances are computed
    once for all. A block pair returns sums of distances by query and cluster, never pairs."""

    points = points.where("vec IS NOT NULL")
    names = [tuple(r) for r in points.select(F.posexplode("clusters").alias("k", "cluster")).groupBy("k", "cluster").agg(F.count(F.lit(1))).limit(MEMBERS + 1).collect()]
    if len(names) > MEMBERS:
        return _many_silhouettes(points)
    names = sorted(names)
    ks = np.array([k for k, *_ in names], dtype=np.int64)
    clusters, sizes = np.array([c for _, c, _ in names], dtype=np.int64), np.array([n for *_, n in names], dtype=np.float64)

    def members(table):
        """Which cluster of each place a row is in: a matrix of 0 and 1, a column a cluster."""
        own = _matrix(table["clusters"], np.int64)
        return (own[:, ks] == clusters).astype(np.float64)

    def sums(number, block, others):
        ids, vectors, mine = block["id"].to_numpy(), _matrix(block["vec"]), members(block)
        total = np.zeros((len(ids), len(ks)))
        for k, other in others:
            there = members(other)
            for some, d in _sliced(vectors, _matrix(other["vec"])):
                if k == number:
                    d[ids[some][:, None] == ids[None, :]] = 0.0
                total[some] += d @ there
        return pa.table({"block": pa.array([number], pa.int64()), "ids": [ids.tobytes()], "mine": [mine.astype(np.int8).tobytes()], "total": [total.tobytes()]})

    def scores(key, rows):
        """Of each place: the sum of its scores in a block, and their number."""
        rows = rows.to_pydict()
        ids, width = np.frombuffer(rows["ids"][0], np.int64), len(ks)
        mine, total = np.frombuffer(rows["mine"][0], np.int8).reshape(-1, width).astype(np.float64), sum(np.frombuffer(t).reshape(-1, width) for t in rows["total"])
        # Rows of one id are all here; they do not count as each other's neighbours.
        _, of = np.unique(ids, return_inverse=True)
        same = np.zeros((of.max() + 1, width))
        np.add.at(same, of, mine)
        count, found = sizes - same[of], []
        for k in np.unique(ks):
            at = np.flatnonzero(ks == k)
            own = mine[:, at].argmax(axis=1)
            # Sums by id and own cluster, as rows of one id can be in several.
            keys, group = np.unique(of * len(at) + own, return_inverse=True)
            t, n = np.zeros((len(keys), len(at))), np.zeros((len(keys), len(at)))
            np.add.at(t, group, total[:, at])
            np.add.at(n, group, count[:, at])
            mean = np.where(n > 0, t / np.maximum(n, 1.0), np.inf)
            inner = keys[:, None] % len(at) == np.arange(len(at))
            first = np.flatnonzero(np.r_[True, keys[1:] // len(at) != keys[:-1] // len(at)])
            a, b = (np.minimum.reduceat(np.where(side, mean, np.inf).min(axis=1), first) for side in (inner, ~inner))
            there, most = np.isfinite(b), np.maximum(a, b)
            score = np.where(np.isfinite(a) & (most > 0), (b - a) / np.where(np.isfinite(most) & (most > 0), most, 1.0), 0.0)
            found.append((int(k), float(score[there].sum()), int(there.sum())))
        return pa.table({"k": pa.array([f[0] for f in found], pa.int32()), "total": pa.array([f[1] for f in found], pa.float64()), "n": pa.array([f[2] for f in found], pa.int64())})

    rows = points.select("id", "clusters", doubles(F.col("vec")).alias("vec"))
    parts = across(rows, sums, "block long, ids binary, mine binary, total binary").groupBy("block").applyInArrow(scores, "k int, total double, n long")
    return parts.groupBy("k").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0).cast("long"))).alias("silhouette"))


def _many_silhouettes(points: DataFrame) -> DataFrame:
    """silhouettes() where clusters are too many for a sum a row and cluster: block pairs return those of the clusters they meet."""

    def sums(key, table):
        ids, clusters, found, members = table["id"].to_numpy(), np.array(table["clusters"].to_pylist(), dtype=np.int64), [_SUMS.empty_table()], None
        for left, right, d in _distances(table):
            if members is None:
                sets = [np.unique(column, return_inverse=True) for column in clusters[right].T]
                members = np.concatenate([(places.reshape(-1, 1) == np.arange(len(names))).astype(np.float64) for names, places in sets], axis=1)
                ks = np.repeat(np.arange(len(sets), dtype=np.int32), [len(names) for names, _ in sets])
                names = np.concatenate([names for names, _ in sets])
                sizes, order = members.sum(axis=0), np.argsort(ids[right], kind="stable")
            d[ids[left][:, None] == ids[right][None, :]] = 0.0
            total, count = d @ members, np.tile(sizes, (len(left), 1))
            # The query itself, which a block that meets itself also holds as a point (rows of one id likewise), does not count.
            low, high = (np.searchsorted(ids[right], ids[left], side, sorter=order) for side in ("left", "right"))
            for row in np.flatnonzero(high > low):
                count[row] -= members[order[low[row] : high[row]]].sum(axis=0)
            found.append(pa.table([
                np.repeat(ids[left], len(names)), np.tile(ks, len(left)), clusters[left][:, ks].ravel(), np.tile(names, len(left)), total.ravel(), count.ravel(),
            ], schema=_SUMS))
        return pa.concat_tables(found)

    parts = _block_pairs(points, "clusters").applyInArrow(sums, "id long, k int, cluster long, oc long, total double, n double")
    means = parts.groupBy("id", "k", "cluster", "oc").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("mean"))
    per = means.groupBy("id", "k").agg(F.min(F.when(F.col("cluster") == F.col("oc"), F.col("mean"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("oc"), F.col("mean"))).alias("b"))
    score = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy("k").agg(F.avg(F.when(F.col("b").isNotNull(), score)).alias("silhouette"))


def silhouette(points: DataFrame) -> DataFrame:
    """The mean silhouette (Euclidean) of points (id, cluster, vec), noise (-1) left out; null with fewer
    than two clusters."""
    one = silhouettes(points.where("cluster <> -1").select("id", F.array(F.col("cluster").cast("long")).alias("clusters"), "vec"))
    return one.agg(F.max("silhouette").alias("silhouette"))


def spread(points: DataFrame, by: str = "cluster") -> DataFrame:
    """Size, centre and root-mean-square distance to it for each cluster of (x, y)."""
    means = cut(points.groupBy(by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")), "means")
    rows = join_checked(points, means, by)
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("size"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.sqrt(F.avg(d2)).alias("spread"), F.avg(F.sqrt(d2)).alias("mean_distance"))


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting: whether a point lies inside a polygon."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y0 != y1:
            crosses = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def standardize(points: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to mean 0 and standard deviation 1; the moments are one row, joined to all."""
    moments = points.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    rows = points.join(F.broadcast(moments))
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0))
    return rows.select(*points.columns)


def hull(points: DataFrame, by: str) -> DataFrame:
    """The convex hull (counter-clockwise, from the lowest x) of each cluster of at least three points.
    Only the corners of each of many small hash groups are kept before the corners of a cluster meet,
    so no task sees a whole cluster."""
    import pandas as pd

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(set(zip(rows["x"], rows["y"])))
        if len(pts) < 3:
            return pd.DataFrame({by: rows[by].iloc[0], "corner": range(len(pts)), "x": [p[0] for p in pts], "y": [p[1] for p in pts]})
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        halves = []
        for order in (pts, pts[::-1]):
            half: list = []
            for p in order:
                while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                    half.pop()
                half.append(p)
            halves += half[:-1]
        return pd.DataFrame({by: rows[by].iloc[0], "corner": range(len(halves)), "x": [p[0] for p in halves], "y": [p[1] for p in halves]})

    schema = f"{by} {points.schema[by].dataType.simpleString()}, corner int, x double, y double"
    rows = points.select(by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    first = salted.groupBy(by, "_salt").applyInPandas(lambda p: chain(p[[by, "x", "y"]]), schema)
    return first.select(by, "x", "y").groupBy(by).applyInPandas(chain, schema)
