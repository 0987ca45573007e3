import numpy as np

from graphloom.llm import op2_hyperplanes as op


def brute(rows, threshold):
    """(n_links, component) by all pairs and union-find."""
    unit = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float64)
        unit[k] = x / np.linalg.norm(x)
    links, parent = {k: 0 for k in range(len(rows))}, {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return [(links[k], None if rows[k][0] is None else find(rows[k][0])) for k in range(len(rows))]


def check(spark, rows, **extra):
    df = spark.createDataFrame([(*r, 9, 8) for r in rows], "vec_id long, embedding array<float>, label int, class int, links int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in op.near_vectors(df).collect())
    want = sorted((str(r[0]), n, str(c), r[0] is None or r[0] == c) for r, (n, c) in zip(rows, brute(rows, 0.93)))
    assert got == want


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)  # many block pairs
    rng = np.random.default_rng(3)
    rows = []
    for g in range(30):
        centre = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 9))):
            v = centre + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.25, 0.35])
            rows.append((len(rows) * 2 + 1, v.astype(np.float32).tolist(), int(g % 3)))
    hot = rng.standard_normal(24)
    for _ in range(60):  # one large group of copies and near copies
        rows.append((len(rows) * 2 + 1, (hot + rng.standard_normal(24) * rng.choice([0.0, 0.05])).astype(np.float32).tolist(), 1))
    check(spark, rows)


def test_edges(spark):
    v = [1.0, 0.0, 0.5]
    rows = [
        (1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.5], 1),
        (9, [float("nan"), 1.0, 0.0], 1), (10, [float("inf"), 1.0, 0.0], 1), (11, [1.0, 0.0], 1), (None, v, 1), (12, [-1.0, -0.0, -0.5], 1), (13, [2.0, 0.0, 1.0], 1),
    ]
    check(spark, rows)
    assert op.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_an_id_with_two_vectors(spark):
    """Each row is a vector of its own: labels and components do not mix through the id."""
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 1), (3, [0.1, 1.0], 1), (4, [-1.0, 0.0], 1)]
    rows += [(9, [1.0, 0.0], 5), (9, [1.0, 0.0], 6), (8, [1.0, 0.1], 5), (10, [1.0, 0.1], 6), (10, [1.0, 0.1], 6)]
    got = op.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (8, 1, 8), (9, 1, 8), (9, 2, 9), (10, 2, 9), (10, 2, 9)]


def test_tables_follow_size():
    assert op.plan_tables(100, 0.93)[0] == 1
    bits, tables = op.plan_tables(10**7, 0.93)
    agree = 1 - np.arccos(0.93) / np.pi
    assert bits >= 15 and (1 - agree**bits) ** tables <= op.MISS
