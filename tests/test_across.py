"""All against all without a copy of every row for every block."""

import numpy as np
import pytest

from graphloom.operators import clustering, ward
from tests.test_graph_sizes import shuffled_rows

RNG = np.random.default_rng(6)


def points(spark, n):
    rows = [(i, [i % 2, i % 5], RNG.standard_normal(3).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, clusters array<long>, vec array<double>")


@pytest.mark.parametrize("shares", [1, 4])
def test_blocks_meet_every_row_once(spark, monkeypatch, shares):
    import pyarrow as pa

    monkeypatch.setattr(clustering, "BLOCK", 20)
    monkeypatch.setattr(clustering, "SHARE", 32_000_000 if shares == 1 else 8_000)

    def step(number, block, others):
        there = [(k, i) for k, t in others for i in t["id"].to_pylist()]
        mine = block["id"].to_pylist()
        assert [i for k, i in there if k == number] in ([], mine)
        return pa.table({"id": np.repeat(mine, len(there)), "other": np.tile(np.array([i for _, i in there], dtype=np.int64), len(mine))})

    df = points(spark, 150)
    got = sorted(map(tuple, clustering.across(df.unionAll(df.where("id = 3")), step, "id long, other long").collect()))
    every = sorted([*range(150), 3])
    assert got == sorted((a, b) for a in every for b in every)


@pytest.mark.parametrize("run", [
    lambda df: clustering.silhouettes(df).collect(),
    lambda df: ward.merges(df.select("id", "vec")).collect(),
])
def test_rows_moved_do_not_follow_the_number_of_blocks(spark, monkeypatch, run):
    monkeypatch.setattr(clustering, "BLOCK", 150)
    few = shuffled_rows(spark, lambda: run(points(spark, 1200)))[1]
    monkeypatch.setattr(clustering, "BLOCK", 40)
    many = shuffled_rows(spark, lambda: run(points(spark, 1200)))[1]
    assert many < 2 * few + 1200 and few < 20_000


def test_repeated_ids_are_one_point_in_silhouettes(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 15)
    df = points(spark, 60)
    df = df.unionAll(df.where("id % 7 = 0").selectExpr("id", "array(clusters[0], 9L - clusters[1]) AS clusters", "vec"))
    got, want = (sorted(map(tuple, run(df).collect())) for run in (clustering.silhouettes, clustering._many_silhouettes))
    assert [k for k, _ in got] == [0, 1] and np.allclose(got, want)
