"""Memory of block pairs, and nearest clusters against all differences."""

import tracemalloc

import numpy as np
import pyarrow as pa

from graphloom.operators import clustering, ward

RNG = np.random.default_rng(5)


def block(n, dims):
    vectors = RNG.standard_normal((2 * n, dims))
    vectors[: n // 50] = vectors[n : n + n // 50]  # some at distance 0
    ids = np.r_[np.arange(n), np.arange(n // 2, n // 2 + n)]
    return vectors, pa.table({"id": pa.array(ids), "vec": pa.array(list(vectors), pa.list_(pa.float64())), "is_query": pa.array(np.arange(2 * n) < n), "n": pa.array(RNG.integers(1, 6, 2 * n))})


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_distances_come_in_slices():
    vectors, table = block(1500, 2)
    seen, most = peak(lambda: sum(float(d.sum()) for _, _, d in clustering._distances(table)))
    assert most < 16e6
    assert np.isclose(seen, np.sqrt(((vectors[:1500, None] - vectors[None, 1500:]) ** 2).sum(axis=2)).sum())


def test_nearest_clusters_in_slices_equal_all_differences():
    vectors, table = block(1500, 8)
    found, most = peak(lambda: ward._nearest(None, table))
    assert most < 24e6
    ids, n = table["id"].to_numpy(), table["n"].to_numpy().astype(float)
    a, b = n[:1500, None], n[None, 1500:]
    height = np.sqrt(sum((vectors[:1500, k][:, None] - vectors[1500:, k][None, :]) ** 2 for k in range(8))) * np.sqrt(2 * a * b / (a + b))
    height[ids[:1500, None] == ids[None, 1500:]] = np.inf
    got = {i: (h, lo, hi) for i, h, lo, hi in zip(*(found[c].to_pylist() for c in ("id", "height", "lo", "hi")))}
    for row in range(1500):
        best = min((height[row, k], min(ids[row], ids[1500 + k]), max(ids[row], ids[1500 + k])) for k in np.argsort(height[row], kind="stable")[:5])
        assert np.isclose(got[ids[row]][0], best[0], atol=1e-12) and got[ids[row]][1:] == best[1:]
