import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import op13_grace_dedup as op


def brute(rows):
    """(doc_id, text) -> multiset of results: equal texts by comparison, the largest id stays once."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            out.append((i, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def copies(spark, n=600):
    rng = random.Random(3)
    texts = [rng.choice(["", "ab", "é" * rng.randrange(1, 9), f"text {rng.randrange(90)} " * rng.randrange(1, 40)]) for _ in range(n)]
    rows = [(i * 7 % n, t, "x") for i, t in enumerate(texts)] + [(5, texts[0], "y"), (None, texts[1], "z"), (None, texts[1], "z"), (None, "alone", "z"), (n + 1, texts[0], "r"), (n + 1, texts[0], "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5)


@pytest.mark.parametrize("room", [op.ROOM, 6000])
def test_equals_brute_force_at_any_room(spark, room):
    """Small tables spill and are partitioned again, level by level."""
    docs = copies(spark)
    assert result(op.deduplicate(docs, room=room)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_contents_are_compared_not_digests(spark):
    """With a digest of one character, hundreds of contents share it; the groups stay those of the texts."""
    docs = copies(spark, 200)
    got = op.deduplicate(docs, room=9000, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1))
    assert result(got) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_hot_group_and_shuffled_rest(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT", 4)
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i // 4}") for i in range(300)], "doc_id long, text string")
    assert result(op.deduplicate(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_levels_end(spark):
    """A bucket that does not fit is written as spill records once, and every content is found at some level."""
    batch = op._batch([(f"{k % 7}", bytes([k % 50]) * 100, k, 1, 1, False) for k in range(200)])
    out = [r for b in op._resolve(iter([batch]), 1000) for r in b.to_pylist()]
    assert all(r["spilled"] for r in out) and sum(r["n"] for r in out) == 200
    one = op._batch([("d", bytes([k % 3]) * 900, k, 1, 1, False) for k in range(9)])
    assert [(r["n"], r["spilled"]) for b in op._resolve(iter([one]), 1000) for r in b.to_pylist()] == [(3, False)] * 3


def test_edges(spark, edge_docs, empty_docs):
    assert result(op.deduplicate(edge_docs)) == brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert op.deduplicate(empty_docs).collect() == []
    left = op.distinct_rows(edge_docs)
    assert left.columns == edge_docs.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter({r.text or "" for r in edge_docs.collect()})
