"""Approximate nearest neighbours: an inverted file over k-means cells.

Cells are fitted on a bounded sample; every row is indexed in the nearest cell, large cells in several
blocks. How many cells a query looks into follows from a recall target: for a bounded sample of rows the
exact neighbours are found in all rows, and the ranks of their cells among the cells nearest to the query
tell how many must be opened to meet the target. Products are taken blockwise in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut
from graphloom.operators.clustering import lloyd
from graphloom.operators.similarity import dot, doubles

#: Rows that the cells are fitted on at most, cells at most (the model is cells x dimensions), rows of a block, rows
#: that the recall is measured on.
SAMPLE, CELLS, BLOCK, TUNED = 20_000, 4096, 8192, 200


def _unit(vector):
    v = doubles(vector)
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def build(points: DataFrame, cells: int | None = None, sample: int = SAMPLE, steps: int = 4) -> tuple[DataFrame, DataFrame]:
    """(index, centres) of points (id, vec). Cells are fitted by Lloyd steps on at most `sample` unit vectors,
    chosen by a hash of the id; index holds every point (id, unit) with its cell and block. Some sqrt(n)
    cells by default, at most CELLS. Points whose vector is null, empty or zero have no direction and are
    left out."""
    kept = points.where(F.col("vec").isNotNull()).where(F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False)))
    units = cut(kept.select("id", _unit(F.col("vec")).alias("unit")), "units")
    cells = cells or max(1, min(CELLS, math.isqrt(units.count())))
    fitted = cut(units.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", F.col("unit").alias("vec")), "fitted")
    rank = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(1), "id"), "id"))  # over the bounded sample
    seeds = cut(fitted.withColumn("cluster", rank.cast("long")).where(F.col("cluster") <= cells).select("cluster", F.col("vec").alias("centre")), "seeds")
    placed = lloyd(fitted, seeds, steps).join(fitted, "id")
    means = placed.select("cluster", F.posexplode("vec").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("x"))
    centres = cut(means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centre")), "centres")
    placed = cut(_nearest(units, centres, 1).select("id", "unit", F.col("cells")[0].alias("cell")), "placed")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # a row a cell
    index = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    return cut(index, "index"), centres


def _nearest(units: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """units with the n nearest cells by inner product; the model of at most CELLS centres goes with the task."""
    model = centres.orderBy("cluster").collect()
    names, matrix = np.array([r.cluster for r in model], np.int64), np.array([r.centre for r in model], np.float64)
    n = min(n, len(model))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                products = _rows(part.column(part.schema.get_field_index("unit"))) @ matrix.T
                best = names[np.argsort(-products, axis=1, kind="stable")[:, :n]]
                cells = pa.ListArray.from_arrays(np.arange(0, best.size + 1, n, dtype=np.int32), best.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=[*part.schema.names, "cells"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    return units.mapInArrow(assign, f"{schema}, cells array<long>")


def _best(k: int):
    """The k best of one block for each query of it, without the query's own row."""

    def run(key, table):
        asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        left, right = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            ids, vectors = right["id"].to_numpy(), _rows(right["unit"])
            for at in range(0, left.num_rows, 512):
                part = left.slice(at, 512)
                scores, own = _rows(part["unit"]) @ vectors.T, part["id"].to_numpy()
                scores[own[:, None] == ids[None, :]] = -np.inf
                for q, s in zip(own, scores):
                    best = np.lexsort((ids, -s))[:k]
                    best = best[np.isfinite(s[best])]
                    for held, found in zip(out, (np.full(len(best), q), ids[best], s[best])):
                        held.append(found)
        joined = [np.concatenate(x) if x else np.empty(0) for x in out]
        return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "id": pa.array(joined[1].astype(np.int64)), "score": pa.array(joined[2].astype(np.float64))})

    return run


def _ranked(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """asked: (id, unit, cell, block), each query in every block that it looks into."""
    sides = index.select("cell", "block", "id", "unit", F.lit(False).alias("asks")).unionByName(asked.withColumn("asks", F.lit(True)))
    found = sides.groupBy("cell", "block").applyInArrow(_best(k), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _opened(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(id, unit, cell) of queries -> a row for each block of the cell."""
    blocks = index.select("cell", "blocks").distinct()
    return queries.join(F.broadcast(blocks), "cell").select("id", "unit", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))


def probes_for(index: DataFrame, centres: DataFrame, target: float = 0.95, k: int = 10, sample: int = TUNED) -> int:
    """How many cells to open so that a share `target` of the exact k nearest neighbours is found, measured on at
    most `sample` indexed rows against all rows."""
    held = cut(index.select("id", "unit").orderBy(F.xxhash64(F.lit(2), "id"), "id").limit(sample), "held")
    every = index.select("cell").distinct()
    near = _ranked(index, _opened(held.join(F.broadcast(every)), index), k)
    cells = _nearest(held, centres, CELLS).select(F.col("id").alias("query_id"), F.posexplode("cells").alias("at", "cell"))
    ranks = near.join(index.select("id", "cell"), "id").join(cells, ["query_id", "cell"])
    found = ranks.agg(F.percentile("at", target).alias("at")).first().at
    return 1 if found is None else int(math.ceil(found)) + 1


def search(index: DataFrame, centres: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, target: float = 0.95) -> DataFrame:
    """query_id, rank, id, score of each query's k best among the points of its `probes` nearest cells, by
    exact cosine, without the query's own row; without probes, of so many cells as the recall target asks for.
    Queries (id, vec) meet points in the blocks of a cell; a block gives k rows a query at most."""
    probes = probes or probes_for(index, centres, target, k)
    asked = _nearest(queries.select("id", _unit(F.col("vec")).alias("unit")), centres, probes)
    return _ranked(index, _opened(asked.select("id", "unit", F.explode("cells").alias("cell")), index), k)
