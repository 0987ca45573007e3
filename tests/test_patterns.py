"""Pattern queries on a small graph, against all combinations of edges."""

import itertools
import random

import pytest

from graphloom.operators.patterns import Graph


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(1)
    edges = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(26)})
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(9)], "id long, name string")
    made = spark.createDataFrame([(a, b, (a + b) % 3) for a, b in edges], "src long, dst long, w int")
    return Graph({"N": nodes, "M": nodes.where("id < 3")}, {"E": made, "K": made.where("w = 1").where("src < 3")}, {"E": ("N", "N"), "K": ("M", "N")}), edges


@pytest.mark.parametrize("least, most", [(1, 1), (1, 3), (2, 3), (0, 2)])
def test_walks_use_no_edge_twice(small, least, most):
    graph, edges = small
    got = sorted(tuple(r.p) for r in graph.match("a", "N").walk("E", "p", "b", least, most).rows.collect())
    want = [(i,) for i in range(9)] if least == 0 else []
    for n in range(max(least, 1), most + 1):
        for trail in itertools.permutations(edges, n):
            if all(x[1] == y[0] for x, y in zip(trail, trail[1:])):
                want.append((trail[0][0], *[e[1] for e in trail]))
    assert got == sorted(want)


def test_steps_cycles_and_conditions(small):
    graph, edges = small
    found = graph.match("a", "N").out("E", "x", "b").out("E", "y", "c", where="w = 2").back("E", "z", "a")
    got = sorted((r.a_id, r.b_id, r.c_id) for r in found.rows.collect())
    want = sorted(
        (a, b, c) for (a, b), (b2, c), (a2, c2) in itertools.permutations(edges, 3)
        if b2 == b and a2 == a and c2 == c and (b2 + c) % 3 == 2
    )
    assert got == want and got


def test_without_either_way(small):
    graph, edges = small
    last = {i for i in range(9) if not [e for e in edges if e[0] == i]}
    first = {i for i in range(9) if not [e for e in edges if e[1] == i and (e[0] + i) % 3 == 0]}
    assert {r.a_id for r in graph.match("a", "N").without("E").rows.collect()} == last
    assert {r.a_id for r in graph.match("a", "N").without("E", "w = 0", backwards=True).rows.collect()} == first
    assert {r.m_id for r in graph.match("m", "M").out("K", "k", "n").rows.collect()} == {a for a, b in edges if a < 3 and (a + b) % 3 == 1}


def test_fold_warns_only_when_it_cuts(small):
    graph, edges = small
    found = graph.match("a", "N").out("E", "x", "b")
    ends = {i for e in edges for i in e}
    whole = found.fold(len(ends), len(edges))
    assert whole.nodes.count() == len(ends) and whole.edges.count() == len(edges) and whole.warnings.count() == 0
    part = found.fold(3, len(edges) - 1).table().collect()
    assert sorted(r.name for r in part if r.kind == "warning") == ["nodes truncated to 3", f"relationships truncated to {len(edges) - 1}"]
    assert [r.id for r in part if r.kind == "node"] == sorted(map(str, ends))[:3]
    assert graph.match("a", "N").fold().edges.count() == 0
