"""The kept index against plain counting."""

import math
import random
import re
from collections import Counter

import pytest

from graphloom.operators import inverted


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(rng.choice("AB"), str(i), " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(40)], k=rng.choice([1, 4, 30, 200])))) for i in range(300)]
    rows += [("A", "one", "W1, w1; Ünï-code 7"), ("B", "none", None), ("B", "blank", " ,"), ("A", "x", "w1"), ("B", "x", "w1")]
    docs = spark.createDataFrame(rows, "label string, id string, text string").repartition(3)
    return inverted.build(docs, f"file://{tmp_path_factory.mktemp('index')}/kept"), rows, docs


def brute(rows, text, k):
    split = lambda t: [x for x in re.split(r"[^\w]|_", (t or "").lower()) if x]
    docs = {(label, i): Counter(split(t)) for label, i, t in rows if split(t)}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    out = []
    for key, counts in docs.items():
        length, score, hits = sum(counts.values()), 0.0, 0
        for term in set(split(text)):
            if counts[term]:
                df = sum(1 for c in docs.values() if c[term])
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * counts[term] * 2.2 / (counts[term] + 1.2 * (0.25 + 0.75 * length / mean))
                hits += counts[term]
        if hits:
            out.append((-round(score, 9), *key, sum(counts[t] > 0 for t in set(split(text))), hits))
    return sorted(out)[:k]


@pytest.mark.parametrize("text, k", [("w1", 5), ("w0 w39", 3), ("W2 w30, w31 w32!", 10), ("w0 w1 w2 w3 w4", 1), ("ünï w7", 400), ("nothing", 5), ("", 5), ("w5 w5", 20)])
def test_search_equals_plain_scores(corpus, text, k):
    index, rows, _ = corpus
    got = [(-round(r.score, 9), r.label, r.id, r.matched, r.hits) for r in inverted.search(index, text, k).collect()]
    assert got == brute(rows, text, k)


def test_matches_counts_every_document(corpus):
    index, rows, _ = corpus
    got = {(r.label, r.id): (r.matched, r.hits) for r in inverted.matches(index, ["W1", "w20"]).collect()}
    assert got == {(label, i): (m, h) for _, label, i, m, h in brute(rows, "w1 w20", 10**6)}


def test_a_search_reads_its_own_buckets(corpus):
    index, _, docs = corpus
    plan = index.of("postings", ["w1", "w2"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(term" in plan
    assert len({r.bucket for r in index.of("postings", ["w1", "w2"]).select("bucket").distinct().collect()}) <= 2
    assert inverted.build(docs.limit(0), index.path) == index


def test_empty_table(spark, tmp_path):
    index = inverted.build(spark.createDataFrame([], "label string, id string, text string"), f"file://{tmp_path}/none")
    assert inverted.search(index, "w1").collect() == [] and inverted.matches(index, ["w1"]).collect() == []
