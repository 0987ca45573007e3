"""Vector search, fusion and near-duplicate joins."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut, join_checked

#: Rows of a block in an exact all-against-all comparison.
BLOCK = 4096


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    a, b = doubles(a), doubles(b)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def ranked(points: DataFrame, query: DataFrame, k: int, offset: int = 0, threshold: float | None = None) -> DataFrame:
    """The k points nearest to each query vector by cosine: query has qid and qvec (few rows, as given by
    a user; broadcast), points have id and vec. Ties go to the smaller id."""
    hits = points.join(F.broadcast(query)).withColumn("score", cosine(F.col("vec"), F.col("qvec")))
    if threshold is not None:
        hits = hits.where(F.col("score") >= threshold)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank").between(offset + 1, offset + k))


def fuse(rankings: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (id, rank): the sum of 1 / (c + rank), best k."""
    parts = None
    for r in rankings:
        one = r.select("id", (1 / (c + F.col("rank"))).alias("part"))
        parts = one if parts is None else parts.unionAll(one)
    return parts.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def similar_pairs(points: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """Pairs (a < b, score) of points (id, vec) with cosine >= threshold; with `most`, each point as the
    smaller end keeps its best pairs. Exact: points are dealt to blocks, and each pair of blocks is one
    task that multiplies two matrices. For a threshold near 1 on a large table, block by a locality-
    sensitive hash first."""
    n = max(1, -(-points.count() // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    dealt = points.select("id", doubles(F.col("vec")).alias("vec"), block.alias("block")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.select("id", "vec", F.least("block", "mate").alias("lo"), F.greatest("block", "mate").alias("hi"), (F.col("block") > F.col("mate")).alias("right"))

    def compare(key, t):
        ids = t["id"].to_numpy()
        vectors = np.array(t["vec"].to_pylist())
        vectors = vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-300)
        right = t["right"].to_numpy(zero_copy_only=False).astype(bool)
        left_at = np.flatnonzero(~right)
        right_at = left_at if key[0] == key[1] else np.flatnonzero(right)
        scores = vectors[left_at] @ vectors[right_at].T
        a, b = np.nonzero(scores >= threshold)
        x, y = ids[left_at][a], ids[right_at][b]
        keep = x < y if key[0] == key[1] else x != y
        return pa.table({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "score": scores[a, b][keep]})

    pairs = dealt.groupBy("lo", "hi").applyInArrow(compare, "a long, b long, score double")
    if most is not None:
        order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
        pairs = pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
    return pairs


def hash_bits(tokens: Column, bits: int = 64) -> Column:
    """A simhash: for each bit, whether more token hashes have it set than not. The token hash is the
    first sixteen hex digits of MD5. Without tokens, also for null, all bits are 0."""

    @F.arrow_udf("string")
    def codes(lists: pa.Array) -> pa.Array:
        # Each word of a batch is hashed once; votes are added text by text.
        words = lists.flatten().dictionary_encode()
        digests = b"".join(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:8] for w in words.dictionary.to_pylist())
        votes = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
        votes = np.vstack([votes, np.full((1, 64), -1, np.int8)])  # the last row is that of a null word
        at = words.indices.fill_null(len(votes) - 1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        out, begin = [], 0
        for end in ends:
            out.append(((votes[at[begin:end]].sum(axis=0, dtype=np.int64) > 0)[:bits] + 48).astype(np.uint8).tobytes().decode())
            begin = end
        return pa.array(out, pa.string())

    return codes(tokens)


#: Rows of a task of hamming_pairs(), a row a code and key.
KEYED = 1_000_000


def hamming_pairs(codes: DataFrame, most: int = 5, bits: int = 64, spare: int = 3) -> DataFrame:
    """Pairs (a < b, distance) of codes (id, code as a bit string) at Hamming distance <= most. A code is
    split into most + spare blocks, of which two such codes share `spare` at least; every choice of spare
    blocks is an equi-join key (at 64 bits and most = 5: 56 keys of 24 bits), so few unrelated codes
    meet. What moves is a hash of the key, the id and the code as longs; the blocks are compared where codes meet.
    A pair counts under the first key it shares, and distances are bit counts of longs. Equal codes
    are compared once: a pair of smallest ids stands for a pair of classes, and code_classes() tells whose
    ids a class holds, which are the links at distance 0. The number of tasks follows the codes."""
    n = most + spare
    edges = [round(bits * k / n) for k in range(n + 1)]
    starts = list(range(0, bits, 32))
    word = lambda at: F.conv(F.substring("code", at + 1, 32), 2, 10).cast("long").alias(f"w{at}")
    # Bits of a block within the word that starts at a bit; the last word may be shorter.
    mask = lambda at, k: sum(1 << (min(at + 32, bits) - 1 - i) for i in range(max(at, edges[k]), min(at + 32, edges[k + 1])))
    keys = list(combinations(range(n), spare))
    groups = cut(codes.groupBy("code").agg(F.min("id").alias("id")).select("id", *map(word, starts)), "codes").where("w0 IS NOT NULL")
    cuts = [[F.col(f"w{at}").bitwiseAND(F.lit(sum(mask(at, k) for k in chosen)).cast("long")) for at in starts] for chosen in keys]
    key = F.posexplode(F.array(*[F.xxhash64(F.lit(k), *words) for k, words in enumerate(cuts)])).alias("k", "key")
    tasks = max(1, -(-groups.count() * len(keys) // KEYED))
    keyed = groups.select("id", *[f"w{at}" for at in starts], key).repartition(tasks, "key")
    other = keyed.select(F.col("id").alias("b"), F.col("k").alias("kb"), "key", *[F.col(f"w{at}").alias(f"v{at}") for at in starts])
    apart = [F.col(f"w{at}").bitwiseXOR(F.col(f"v{at}")) for at in starts]
    distance = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0]))
    met = keyed.join(other.hint("merge"), "key").where("id < b AND k = kb").withColumn("distance", distance).where(F.col("distance") <= most)
    alike = [reduce(Column.__and__, [x.bitwiseAND(F.lit(mask(at, k)).cast("long")) == 0 for at, x in zip(starts, apart)]) for k in range(n)]
    # The first `spare` blocks that both share name the first key.
    same = F.slice(F.array_compact(F.array(*[F.when(x, i) for i, x in enumerate(alike)])), 1, spare)
    mine = F.element_at(F.array(*[F.array(*map(F.lit, chosen)) for chosen in keys]), F.col("k") + 1)
    return met.where(same == mine).select(F.col("id").alias("a"), "b", "distance")


def code_classes(codes: DataFrame) -> DataFrame:
    """(id, class) of every row of codes (id, code): class is the smallest id with the same code, the
    id by which hamming_pairs() names the code. A row without a code is a class by itself."""
    codes = cut(codes.select("id", "code"), "codes")
    classes = cut(codes.where("code IS NOT NULL").groupBy("code").agg(F.min("id").alias("class")), "classes")
    return join_checked(codes, classes, "code", "left").select("id", F.coalesce("class", "id").alias("class"))
