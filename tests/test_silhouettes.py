"""Several silhouettes of one table against the plain formula."""

import math

import numpy as np

from graphloom.operators import clustering


def test_silhouettes_of_several_clusterings_equal_the_plain_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [int(rng.integers(0, 3)), i % 2, 7, i if i < 2 else 5], rng.standard_normal(2).tolist()) for i in range(60)]
    got = {r.k: r.silhouette for r in clustering.silhouettes(spark.createDataFrame(rows, "id long, clusters array<long>, vec array<double>")).collect()}
    x = np.array([v for *_, v in rows])
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(axis=2))
    for k in range(4):
        c, scores = np.array([r[1][k] for r in rows]), []
        for i in range(60):
            other = [d[i, c == o].mean() for o in set(c.tolist()) - {c[i]}]
            mates = (c == c[i]) & (np.arange(60) != i)
            if other:
                a, b = (d[i, mates].mean() if mates.any() else None), min(other)
                scores.append(0.0 if a is None else (b - a) / max(a, b))
        assert got[k] is None if not scores else math.isclose(got[k], np.mean(scores), abs_tol=1e-9)
