"""Connected components by alternating large-star and small-star rounds over contracted edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scratch import cut


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (smallest node reached, node) for every other node: the same components with fewer edges."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[: len(a)], places[len(a) :]
    low = np.arange(len(nodes))
    while True:
        best = np.minimum(low[a], low[b])
        fresh = low.copy()
        for end in (low[a], low[b]):
            np.minimum.at(fresh, end, best)
        fresh = fresh[fresh]
        if (fresh == low).all():
            break
        low = fresh
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[low[moved]], nodes[moved]


#: Edges that _contract() takes in before it contracts them.
HELD_EDGES = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition (two longs each) as stars. Whenever HELD_EDGES more than the stars so far have come in they are
    contracted, so a task holds these and an edge a node, however many edges its partition has."""
    lo = hi = np.zeros(0, dtype=np.int64)
    parts, held = [], 0
    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held >= max(HELD_EDGES, len(lo)):
            lo, hi = spanning_stars(np.concatenate([lo, *(p[0] for p in parts)]), np.concatenate([hi, *(p[1] for p in parts)]))
            parts, held = [], 0
    if held:
        lo, hi = spanning_stars(np.concatenate([lo, *(p[0] for p in parts)]), np.concatenate([hi, *(p[1] for p in parts)]))
    if len(lo):
        yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["lo", "hi"])


#: Edges that one task contracts (16 bytes each).
TASK_EDGES = 500_000


def components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another node; the component is the
    smallest node of the connected component. Nodes are long.

    Tasks of at most TASK_EDGES edges first contract their edges to stars, which changes no component
    and leaves one edge a node at most; where all edges fit one task, that settles it. Else a round is
    two aggregations and two joins on the edges, never a collection of a neighbourhood, and a
    contraction; rounds end when the edges form disjoint stars. Edges with a null end and loops are
    ignored.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    edge = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    for _ in range(max_rounds):
        edge = cut(edge.distinct(), "edges")
        tasks = max(1, -(-edge.count() // TASK_EDGES))
        edge = cut(edge.coalesce(tasks).mapInArrow(_contract, "lo long, hi long"), "stars")
        if tasks == 1 or _disjoint_stars(edge):
            return edge.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(edge.select("lo", "lo").distinct())
        both = edge.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(edge.select("hi", "lo"))
        # Read back as a table, so that both sides of the join are exchanged and a hub's edges can be split.
        nearest = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "nearest")
        large = cut(edge.join(nearest, F.col("lo") == F.col("u")).select(F.col("m").alias("lo"), "hi").distinct(), "edges")
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        edge = (
            large.join(lowest, "hi").where(F.col("lo") != F.col("m"))
            .select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .unionAll(lowest.select(F.col("m").alias("lo"), "hi"))
        )
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def _disjoint_stars(edge: DataFrame) -> bool:
    """Whether every outer node has one edge and is no centre."""
    ends = edge.select(F.col("hi").alias("u"), F.lit(1).alias("outer"), F.lit(0).alias("centre")).unionAll(edge.select("lo", F.lit(0), F.lit(1)))
    per = ends.groupBy("u").agg(F.sum("outer").alias("outer"), F.max("centre").alias("centre"))
    return per.where("outer > 1 OR (outer > 0 AND centre > 0)").isEmpty()
