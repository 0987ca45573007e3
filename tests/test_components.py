import random

from graphloom.operators import components as operator
from graphloom.operators.components import components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5200)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == brute(edges)


def test_many_tasks_take_rounds(spark, monkeypatch):
    """Each task sees a few edges of long paths."""
    monkeypatch.setattr(operator, "TASK_EDGES", 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rng = random.Random(9)
        names = rng.sample(range(10**6), 300)
        edges = list(zip(names, names[1:]))[:150] + list(zip(names[160:], names[161:]))
        df = spark.createDataFrame(edges, "a long, b long")
        assert {r.node: r.component for r in components(df, "a", "b").collect()} == brute(edges)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
