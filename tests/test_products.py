"""Joins whose pairs are many more than their rows."""

from collections import Counter

import pytest

from graphloom.operators import relational as rel
from graphloom.plans import derive


def test_product_by_lists_each_pair_once(spark, monkeypatch):
    for name, value in (("LIST", 7), ("CELL", 20), ("TASK", 50)):
        monkeypatch.setattr(rel, name, value)
    left = [(i, f"k{i % 3 if i % 2 else 0}") for i in range(40)] + [(99, None), (98, "none")]
    right = [(i, f"k{i % 4}") for i in range(60)] + [(97, None)]
    got = rel.product_by(spark.createDataFrame(left, "a long, k string"), spark.createDataFrame(right, "b long, k string"), "k").select("a", "b").collect()
    assert Counter(map(tuple, got)) == Counter((a, b) for a, k in left for b, j in right if k is not None and k == j)
    none = rel.product_by(spark.createDataFrame([], "a long, k string"), spark.createDataFrame(right, "b long, k string"), "k")
    assert none.count() == 0


@pytest.mark.parametrize("query", [derive.library_bridge, derive.implements_from_docs])
def test_pairs_are_neither_shuffled_nor_aggregated(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("== Initial Plan ==")[-1].split("Join")[0]
    assert "Generate explode" in above and "Exchange" not in above and "Aggregate" not in above


def test_few_copies_of_rows_move(spark):
    from tests.test_graph_sizes import shuffled_rows

    left, right = (spark.range(9000).selectExpr(f"id AS {c}", "1L AS k") for c in "ab")
    product = rel.product_by(left, right, "k")
    found, moved = shuffled_rows(spark, product.count)
    assert found == 9000**2 and moved < 22_000
