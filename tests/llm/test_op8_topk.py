import random

import numpy as np

from graphloom.llm import op8_topk as op


def test_block_search_equals_full_products():
    rng = np.random.default_rng(2)
    block = rng.integers(-200, 200, (900, 40))
    block[100:200] = block[0]  # ties
    ids = np.arange(900) * 2
    queries = block[[0, 5, 899]]
    found = op.search_block(queries, ids[[0, 5, 899]], block, ids, 5)
    for q, own in enumerate((0, 5, 899)):
        scores = block @ queries[q]
        want = sorted((-s, i) for s, i, k in zip(scores, ids, range(900)) if k != own)[:5]
        assert [(-s, ids[i]) for p, i, s in zip(*found) if p == q] == [(int(a), int(b)) for a, b in want]


def test_large_components_stay_exact():
    a = np.array([[2**30, -(2**30), 3]])
    assert op._products(a, a.T)[0, 0] == 2**61 + 9


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "CANDIDATES", 64)
    monkeypatch.setattr(op, "QUERIES", 4)
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 1) for i in range(300)]
    rows += [(400, None, 1), (450, [1.0, None] * 4, 1), (500, [float("nan")] * 8, 1), (550, [0.5] * 4, 1), (600, [0.1] * 8, 1), (None, [0.1] * 8, 1), (7, rows[7][1], 1), (651, [], 1)] + [(700, [1.0] * 8, 1)] * 2 + [(3, rows[3][1], 1)] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = op.quantise(df).cache()
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op.top_k(whole.where("vec_id % 50 = 0"), whole, 5).collect())
    vectors = sorted((r.vec_id, tuple(r.whole)) for r in whole.collect())
    want = []
    for q, v in sorted(set(vectors)):
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_repeated_candidates_count(spark):
    rows = [(50, [1.0, 0.0])] + [(1, [0.5, 0.5])] * 2 + [(2, [0.25, 1.0])]
    whole = op.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op.top_k(whole.where("vec_id % 50 = 0"), whole, 5).collect())
    assert got == [(50, 1, 1, 128 * 256), (50, 2, 1, 128 * 256), (50, 3, 2, 64 * 256)]


def test_empty(spark):
    none = op.quantise(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert op.top_k(none, none).count() == 0
