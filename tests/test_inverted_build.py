"""Building the index: what moves, and ids that repeat."""

import random

from graphloom.operators import inverted
from tests.test_graph_sizes import shuffled_rows
from tests.test_inverted import brute


def test_postings_move_once(spark, tmp_path):
    rng = random.Random(8)
    rows = [("A", str(i), " ".join(rng.choices([f"w{k}" for k in range(60)], k=60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "label string, id string, text string").repartition(3)
    index, moved = shuffled_rows(spark, lambda: inverted.build(docs, f"file://{tmp_path}/kept"))
    postings = index.table("postings").count()
    assert postings == sum(len(set(t.split())) for _, _, t in rows)
    assert moved < 1.5 * postings


def test_texts_of_an_id_that_repeats_are_one_document(spark, tmp_path):
    rows = [("A", "1", "w1 w2 w2"), ("A", "1", "w2 w3 w4"), ("A", "2", "w2"), ("B", "1", "w1 w1"), ("B", "3", None), ("B", "3", "w4")]
    index = inverted.build(spark.createDataFrame(rows, "label string, id string, text string"), f"file://{tmp_path}/kept")
    merged = [("A", "1", "w1 w2 w2 w2 w3 w4"), ("A", "2", "w2"), ("B", "1", "w1 w1"), ("B", "3", "w4")]
    got = [(-round(r.score, 9), r.label, r.id, r.matched, r.hits) for r in inverted.search(index, "w1 w2 w4", 9).collect()]
    assert got == brute(merged, "w1 w2 w4", 9)
    assert {(r.label, r.id, r.len) for r in index.table("docs").collect()} == {("A", "1", 6), ("A", "2", 1), ("B", "1", 2), ("B", "3", 1)}
