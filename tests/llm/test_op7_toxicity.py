from zlib import crc32

import numpy as np

from graphloom.llm import op7_toxicity as op


def labelled(spark, n=300):
    insults = ["blarg", "zorkish", "muffwit"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 2
        words = [f"word{(i * 7 + k) % 40}" for k in range(20 + i % 30)]
        if toxic:
            words.insert(i % 15, insults[i % 3])
        docs.append((i, " ".join(words), i))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, n long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_finds_insults_in_held_out_documents(spark):
    docs, labels = labelled(spark)
    rows = op.classify(docs, labels).collect()
    assert len(rows) == 300
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) == int(r.doc_id % 5 == 2)


def test_pairs_equal_brute_force():
    machine = op.FactorizationMachine(np.arange(50), 0.3)
    rng = np.random.default_rng(1)
    machine.w, machine.v = rng.standard_normal(50), rng.standard_normal((50, op.FACTORS))
    lists = [rng.choice(50, size=k, replace=False) for k in (0, 1, 2, 9)]
    sizes = np.array([len(x) for x in lists])
    raw = machine.raw(np.concatenate(lists), np.cumsum(sizes) - sizes, len(lists))[0]
    for x, got in zip(lists, raw):
        want = machine.bias + machine.w[x].sum() + sum(machine.v[a] @ machine.v[b] for i, a in enumerate(x) for b in x[:i])
        assert abs(want - got) < 1e-9


def test_interaction_is_learnt():
    """Only the pair is toxic; either term alone is not."""
    machine = op.FactorizationMachine(np.arange(3), 0.25, seed=3)
    machine.v *= 30
    lists = [np.array(x) for x in ([0], [1], [0, 1], [2])] * 60
    y = np.array([0, 0, 1, 0] * 60, float)
    machine.fit(lists, y, np.ones(len(y)), epochs=60)
    sizes = np.array([len(x) for x in lists[:4]])
    assert list((machine.score(np.concatenate(lists[:4]), np.cumsum(sizes) - sizes, 4) >= 0.5).astype(int)) == [0, 0, 1, 0]


def test_edges(spark, edge_docs, empty_docs):
    _, labels = labelled(spark)
    assert op.classify(edge_docs, labels).count() == edge_docs.count()
    assert op.classify(empty_docs, labels).count() == 0
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in op.classify(edge_docs, none).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert op.classify(edge_docs, both).count() == edge_docs.count()


def test_held_out_labels_of_the_documents(spark):
    """Accuracy and AUC on rows that were never learnt from."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in op.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    ones, zeros = ([s for s, _, y in rows if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert len(rows) > 40 and np.mean([p == y for _, p, y in rows]) >= 0.98 and auc >= 0.96
