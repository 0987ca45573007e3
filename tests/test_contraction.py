"""Memory of a contraction."""

import tracemalloc

import numpy as np
import pyarrow as pa

from graphloom.operators import components


def test_contraction_holds_nodes_not_edges():
    rng = np.random.default_rng(3)

    def batches():
        for k in range(200):
            a = rng.integers(0, 1000, 10_000) * 2 + k % 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array((a + 2 * rng.integers(1, 50, 10_000)) % 2000)], names=["lo", "hi"])

    tracemalloc.start()
    stars = list(components._contract(batches()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    lo, hi = (np.concatenate([b.column(k).to_numpy() for b in stars]) for k in (0, 1))
    assert set(lo.tolist()) == {0, 1} and sorted(hi.tolist()) == list(range(2, 2000)) and ((hi - lo) % 2 == 0).all()
    assert list(components._contract(iter([]))) == []
