"""DBSCAN by cells against the pairs within eps."""

import itertools
import random

import pytest

from graphloom.operators import clustering
from tests.test_graph_sizes import shuffled_rows


def plain(rows, eps, least):
    near = {}
    for (a, ax, ay), (b, bx, by) in itertools.permutations([r for r in rows if None not in r], 2):
        if a != b and (ax - bx) ** 2 + (ay - by) ** 2 <= eps * eps:
            near.setdefault(a, []).append(b)
    core, cluster = {a for a in near if len(near[a]) + 1 >= least}, {}
    for c in sorted(core):
        todo = [c] if c not in cluster else []
        while todo:
            at = todo.pop()
            if at not in cluster:
                cluster[at] = c
                todo += [b for b in near[at] if b in core]
    found = {a: cluster[a] if a in core else cluster[min(b for b in bs if b in core)] for a, bs in near.items() if a in core or any(b in core for b in bs)}
    return {a: found.get(a, -1) for a, *_ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_cells_equal_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(1000 - i, round(rng.uniform(-1, 1), 6), round(rng.uniform(-1, 1), 6)) for i in range(220)]
    rows += [(2000 + i, round(rng.gauss(0.5, 0.05), 6), round(rng.gauss(-0.5, 0.05), 6)) for i in range(60)]
    rows += [(3000 + i, 3.0 + (i % 2) * 0.1 + (i // 20) * 0.055, 4.0 + i * 0.0001) for i in range(40)]  # apart by just over and under eps
    rows += [(4000, None, 1.0), (4001, 50.0, 50.0)] + ([(999, 3.0, 4.001), (4001, 0.5, -0.5)] if seed == 2 else [])
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = clustering.dbscan_plane(df, 0.1, 5).collect()
    assert len(got) == len(rows) and {r.id: r.cluster for r in got} == plain(rows, 0.1, 5)


def test_cells_that_only_inner_points_link(spark):
    """A ring and what is within it: the outermost points of both cells are too far apart."""
    at = lambda k, x, y: [(k + i, x, y) for i in range(5)]
    rows = at(0, 0.0005, 0.0005) + at(10, 0.07, 0.0003) + at(20, 0.055, 0.0699) + at(30, 0.0665, 0.035) + at(40, 0.165, 0.035)
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.cluster for r in clustering.dbscan_plane(df, 0.1, 5).collect()}
    assert got == plain(rows, 0.1, 5) and got[44] == 0
    rows = [r for r in rows if r[0] // 10 != 3]
    got = {r.id: r.cluster for r in clustering.dbscan_plane(spark.createDataFrame(rows, "id long, x double, y double"), 0.1, 5).collect()}
    assert got == plain(rows, 0.1, 5) and got[44] == 40


def test_pairs_of_a_full_cell_are_not_listed(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 0.2), rng.uniform(0, 0.2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got, moved = shuffled_rows(spark, lambda: clustering.dbscan_plane(df, 0.1, 5).select("cluster").distinct().collect())
    assert [r.cluster for r in got] == [0] and moved < 60_000


def test_no_points(spark):
    assert clustering.dbscan_plane(spark.createDataFrame([], "id long, x double, y double"), 0.1, 5).count() == 0
