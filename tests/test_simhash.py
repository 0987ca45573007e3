"""Simhashes against a plain loop, and how much the Hamming join moves."""

import hashlib
import random

from pyspark.sql import functions as F

from graphloom.operators import similarity
from tests.test_graph_sizes import shuffled_rows


def plain(words, bits=64):
    if not words:
        return "0" * bits
    hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) if w is not None else 0 for w in words]
    return "".join("1" if sum(1 if h >> (63 - k) & 1 else -1 for h in hashes) > 0 else "0" for k in range(bits))


def test_simhashes_equal_a_plain_loop_in_one_step(spark):
    rows = [(1, ["a"]), (2, ["a", "b", "ünï"]), (3, []), (4, None), (5, ["a", None]), (6, [f"w{k}" for k in range(99)]), (7, ["b", "a"])]
    df = spark.createDataFrame(rows, "id long, words array<string>").repartition(1)
    for bits in (64, 40):
        got = {r.id: r.code for r in df.select("id", similarity.hash_bits(F.col("words"), bits).alias("code")).collect()}
        assert got == {i: plain(w, bits) for i, w in rows}
    plan = df.select(similarity.hash_bits(F.col("words")))._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan  # one call a text, not a hash for each word and bit


def test_codes_of_other_lengths_lose_no_pair(spark):
    rng = random.Random(5)
    codes = ["".join(rng.choice("01") for _ in range(40)) for _ in range(15)]
    codes += ["".join("10"[int(b)] if k in rng.sample(range(40), 2) else b for k, b in enumerate(c)) for c in codes]
    df = spark.createDataFrame([*enumerate(codes), (99, None)], "id long, code string")
    distance = lambda x, y: sum(a != b for a, b in zip(x, y))
    want = {(i, j, distance(x, y)) for i, x in enumerate(codes) for j, y in enumerate(codes) if i < j and 0 < distance(x, y) <= 3}
    assert {(r.a, r.b, r.distance) for r in similarity.hamming_pairs(df, 3, 40, 2).collect()} == want and want


def test_what_moves_is_small(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, f"{rng.getrandbits(64):064b}") for i in range(500)], "id long, code string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = similarity.hamming_pairs(df)
        _, rows = shuffled_rows(spark, pairs.collect)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows <= 56 * 500 and "blocks" not in pairs._jdf.queryExecution().optimizedPlan().toString()
