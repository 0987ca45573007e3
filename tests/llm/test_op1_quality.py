from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import op1_quality as op
from graphloom.llm.labelled import sample


def labelled(spark, n=160):
    docs = [(i, f"A calm sentence number {i} tells of rivers and of hills." if i % 4 else "BUY!! NOW!! " * (5 + i % 7), i) for i in range(n)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, n, 2)] + [(i, int(i % 4 > 0), 0) for i in range(1, n, 4)]
    return spark.createDataFrame(docs, "doc_id long, text string, n long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_separates_held_out_documents_and_matches_brute_force(spark):
    docs, labels = labelled(spark)
    rows = op.classify(docs, labels).collect()
    assert len(rows) == 160
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == int(r.doc_id % 4 > 0)
    # The blocked products and the vote, document by document in plain numpy.
    space = op.train(docs, labels, ~op.held_out(3, 1))
    got = {r.doc_id: r.score for r in rows}
    for r in docs.limit(12).collect():
        x = space.project(op.describe(r.text, op._Dims())[None])[0].astype(np.float64)
        cosines = np.array([v.astype(np.float64) @ x for v in space.vectors])
        near = np.argsort(-cosines)[: op.NEIGHBOURS]
        votes = np.clip(cosines[near], 0, 1) ** op.SHARPNESS * np.sqrt(space.weight[near])
        assert abs(((votes * space.y[near]).sum() + 1e-3 * space.prior) / (votes.sum() + 1e-3) - got[r.doc_id]) < 1e-2


def test_edges(spark, edge_docs, empty_docs):
    _, labels = labelled(spark)
    assert op.classify(edge_docs, labels).count() == edge_docs.count()
    assert op.classify(empty_docs, labels).count() == 0
    no_labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in op.classify(edge_docs, no_labels).collect()} == {0.5}


def test_sample_is_bounded(spark):
    """A labelled id that is repeated over many rows counts with one text."""
    docs = spark.range(5000).selectExpr("1L AS doc_id", "concat('text ', id) AS text").unionByName(spark.createDataFrame([(2, None), (3, "b"), (3, "a")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    got = sorted((r.doc_id, r.text, r.y) for r in sample(docs, labels, "quality", F.lit(True), 10).collect())
    assert got == [(1, "text 0", 1), (2, None, 0), (3, "a", 0)]


def test_held_out_labels_of_the_documents(spark):
    """Accuracy and AUC on rows that were never learnt from."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in op.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    ones, zeros = ([s for s, _, y in rows if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert len(rows) > 40 and np.mean([p == y for _, p, y in rows]) >= 0.95 and auc >= 0.98
