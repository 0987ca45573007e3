"""Exact top-k search by inner product, columnar branch-and-bound.

Vectors are turned into integers. A first pass scores every query against the LONGEST candidates alone (a
bounded number, those of the largest mass), which gives it a bar that holds in every block: the k-th best
score so far. Then candidates form blocks in vertical layout (one row per dimension), queries form blocks
too, and every block pair is one task. A task goes through its candidates one slice of dimensions at a
time, adding to partial scores, and after each slice keeps only those whose partial score plus the largest
product that the remaining dimensions allow (Cauchy-Schwarz on the remaining mass) still reaches the bar;
a small head of the block, scored in full, may raise the bar before. What is below the first bar never
leaves a task. The bound is exact, ties stay in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut
from graphloom.llm.vectors import finite

CANDIDATES = 8192
QUERIES = 8192
SLICE = 16
HEAD = 256
#: Candidates of the first pass.
LONGEST = 2048
#: Queries of a block that are worked on at once.
AT_ONCE = 256


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles where no sum can exceed 2**53, else by integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def search_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, bars: np.ndarray | None = None):
    """(query position, candidate position, score) of each query's k best in a block, of those that reach its
    bar if it has one (a bar of -2**63 is none); ids must ascend, block is candidates x dimensions."""
    dim = block.shape[1]
    columns = np.ascontiguousarray(block.T)
    cuts = list(range(0, dim, SLICE)) + [dim]
    mass = lambda m, axis: np.sqrt((m.astype(np.float64) ** 2).sum(axis=axis)) * (1 + 1e-9)
    rest_c = [mass(columns[at:], 0) for at in cuts]
    out = []
    for start in range(0, len(queries), AT_ONCE):
        part = queries[start : start + AT_ONCE]
        rest_q = [mass(part[:, at:], 1) for at in cuts]
        head = _products(part, columns[:, :HEAD])
        first = _products(part[:, : cuts[1]], columns[: cuts[1], HEAD:])
        for q in range(len(part)):
            others = np.flatnonzero(ids[:HEAD] != query_ids[start + q])
            known = head[q][others]
            bar = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else None
            if bars is not None and bars[start + q] > -(2**63):
                bar = bars[start + q] if bar is None else max(bar, bars[start + q])
                others, known = others[known >= bar], known[known >= bar]
            alive, partial = np.arange(HEAD, len(ids)), first[q]
            for step in range(1, len(cuts)):
                if step > 1 and len(alive):
                    partial = partial + _products(part[q : q + 1, cuts[step - 1] : cuts[step]], columns[cuts[step - 1] : cuts[step], alive])[0]
                if bar is not None:
                    stay = partial + np.floor(rest_q[step][q] * rest_c[step][alive] + 1e-6) >= bar
                    alive, partial = alive[stay], partial[stay]
            other = ids[alive] != query_ids[start + q]
            places, scores = np.append(others, alive[other]), np.append(known, partial[other])
            best = np.lexsort((ids[places], -scores))[:k]
            out.append((np.full(len(best), start + q), places[best], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int),) * 3


def _search(key, group: pa.Table, k: int) -> pa.Table:
    dim = key[0].as_py()
    is_query = group["is_query"].to_numpy(zero_copy_only=False).astype(bool)
    sides = []
    for rows in (np.flatnonzero(is_query), np.flatnonzero(~is_query)):
        t = group.take(pa.array(rows)).combine_chunks()
        ids = t["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        values = _matrix(t["whole"].combine_chunks(), dim) if len(ids) else np.empty((0, dim), np.int64)
        sides.append((ids[order], values[order], t["bar"].to_numpy()[order], t["rows"].to_numpy()[order]))
    (qids, queries, bars, _), (ids, block, _, rows) = sides
    if not len(qids) or not len(ids):
        found = (np.empty(0, np.int64),) * 3
    else:
        found = search_block(queries, qids, block, ids, k, bars)
    at = found[1].astype(int)
    return pa.table({
        "query_id": pa.array(qids[found[0].astype(int)], pa.int64()), "vec_id": pa.array(ids[at], pa.int64()),
        "score": pa.array(found[2].astype(np.int64)), "rows": pa.array(rows[at], pa.int64()),
    })


def _blocks(queries: DataFrame, candidates: DataFrame, q_blocks: int, c_blocks: int, k: int) -> DataFrame:
    """The best of every block pair: query_id, vec_id, score, rows (how often the candidate is there)."""
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("dim", block(q_blocks).alias("qb"), every(c_blocks).alias("cb"), F.lit(True).alias("is_query"), "vec_id", "whole", "bar", "rows")
    right = candidates.select("dim", every(q_blocks).alias("qb"), block(c_blocks).alias("cb"), F.lit(False).alias("is_query"), "vec_id", "whole", F.lit(-(2**63)).cast("long").alias("bar"), "rows")
    return left.unionByName(right).groupBy("dim", "qb", "cb").applyInArrow(lambda key, t: _search(key, t, k), "query_id long, vec_id long, score long, rows long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k best candidates by integer inner product; columns vec_id, whole (array<long>)
    on both sides. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, all
    candidates if there are fewer than k. A candidate with the query's own vec_id is its own row and
    left out. Rows repeated in full (one id, one vector) are compared once and count as often as they are
    there as candidates, once as a query; an id with several vectors asks with each and keeps the k best
    of all. Vectors of another length take no
    part in a query. Empty inputs give an empty result.
    """
    one = lambda df: df.groupBy("vec_id", "whole").agg(F.count(F.lit(1)).alias("rows")).withColumn("dim", F.size("whole"))
    asked, known = cut(one(queries), "asked"), cut(one(candidates), "known")
    # Blocks by hash of the id; their numbers follow from one count of either side.
    q_blocks = max(1, -(-asked.count() // QUERIES))
    c_blocks = max(1, -(-known.count() // CANDIDATES))
    mass = F.aggregate("whole", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    longest = known.orderBy(mass.desc(), "vec_id").limit(LONGEST)
    first = _blocks(asked.withColumn("bar", F.lit(-(2**63)).cast("long")), longest, q_blocks, 1, k)
    # An id may ask with several vectors: the bar holds for what its k best may be at least.
    bars = first.drop("rows").distinct().groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"), F.countDistinct("vec_id").alias("n"))
    bars = cut(bars.where(F.col("n") >= k).select(F.col("query_id").alias("of"), F.col("scores")[k - 1].alias("found")), "bars")
    barred = asked.join(bars, F.col("vec_id") == F.col("of"), "left").withColumn("bar", F.coalesce("found", F.lit(-(2**63)).cast("long")))
    best = _blocks(barred, known, q_blocks, c_blocks, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # No more than k of a candidate's rows can be among the k best.
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("rows", F.lit(k)))))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) for each component; rows with a null id or a vector that is null,
    empty or holds null or non-finite components are left out."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("whole")
    )


def query(spark, sf_dir):
    rows = cut(quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "quantised")
    return top_k(rows.where("vec_id % 50 = 0"), rows, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.w)), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON c.vec_id <> q.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
