import random
import re

import numpy as np
import pytest

from graphloom.llm import op4_minhash as op


def shingles(text, width):
    table = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_brute_force(spark, near_docs, width, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 4)  # many block pairs
    monkeypatch.setattr(op, "REGION", 3)  # open regions
    monkeypatch.setattr(op, "CHUNK", 16)
    rows = [(r.doc_id, r.text) for r in near_docs.collect()]
    want = brute(rows, width)
    got = op.near_duplicates(near_docs, width=width).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    text = dict(rows)
    for r in got:
        assert r.n_shingles == len(shingles(text[r.doc_id], width)) and r.kept == (r.doc_id == r.component_id)


def test_edges(spark, edge_docs, empty_docs):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in op.near_duplicates(edge_docs, width=2).collect())
    assert len(got) == edge_docs.count()
    by = {g[0]: g for g in got}
    assert by["5"][2] == 1 and not by["5"][3]
    assert by["None"][2:] == (None, True)
    assert by["2"][1:] == (0, 2, True) and by["3"][1:] == (0, 3, True) and by["4"][1:] == (0, 4, True)
    assert op.near_duplicates(empty_docs).count() == 0


def test_case_and_white_space(spark):
    docs = spark.createDataFrame([(1, "One TWO\x0bthree"), (2, "one\ttwo   three\n"), (3, "Éa b c"), (4, "éa b c"), (5, "solo"), (6, "SOLO")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op.near_duplicates(docs, width=2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}


def test_depth_follows_the_region():
    """From the deepest prefix on, a region widens while it has at most so many rows."""
    same = np.array([8, 8, 5, 1, 3, 3, 0, 2])
    depth, region = op.region_depths(same, 3)
    assert depth.tolist() == [6, 6, 6, 6, 2, 2, 2, 1, 1]
    for d, start in zip(depth, region):
        members = np.flatnonzero(region == start)
        assert len(members) <= 3 and (d == 0 or (same[members[:-1]] >= d).all())
    deep, _ = op.region_depths(np.full(9, 8), 3)
    assert (deep == 0).all()


def test_estimates_are_right_on_average():
    odd, flip = op._coefficients()
    rng = np.random.default_rng(5)
    got = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base, rng.integers(0, 2**63, 125, dtype=np.uint64)])) for _ in range(2)]
        bits = [((op.signature(x, odd, flip) >> np.uint32(16)) & 15).astype(np.uint8) for x in sets]
        words = [(b[0::2] << 4 | b[1::2]).view("<u8") for b in bits]
        got.append(op._estimates(words[0], words[1]))
    assert abs(np.mean(got) - 0.8) < 0.02 and min(got) > op.least_estimate(80)


def test_recall_just_above_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 among unrelated texts: every one is found, with and without estimates."""
    rng = random.Random(3)
    texts, want = [], 0
    vocabulary = [f"v{i}" for i in range(5000)]
    for _ in range(700):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([60, 150, 400]))]
        copy = list(words)
        while True:  # one word changed costs two shingles on either side
            before = list(copy)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            a, b = shingles(" ".join(words), 2), shingles(" ".join(copy), 2)
            if 100 * len(a & b) < 80 * len(a | b):
                break
        texts += [" ".join(words), " ".join(before)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for estimates in (True, False):
        got = {r.doc_id: r.component_id for r in op.near_duplicates(docs, width=2, estimates=estimates).collect()}
        found = sum(got[2 * k + 1] == got[2 * k] == 2 * k for k in range(700))
        assert found == 700, found


def test_rows_decide_not_ids(spark):
    """A repeated id with another text keeps it; of rows repeated in full one stays."""
    a, b, c = "the first text stands here alone today", "quite another text of the same number", "and a third text that is repeated whole"
    rows = [(1, a, 1), (7, a, 2), (7, b, 3), (2, c, 4), (2, c, 5), (8, None, 6), (8, "", 7), (None, a, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    kept = op.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (7, b), (2, c), (8, None), (8, ""), (None, a)], key=str)
