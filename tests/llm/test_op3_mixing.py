import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np

from graphloom.llm import op3_mixing as op


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix_meets_targets(spark, edge_docs, near_docs):
    docs = near_docs.unionByName(edge_docs.where("doc_id is null or doc_id <> 6").select(*near_docs.columns))
    source = {(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))): r.source for r in docs.collect()}
    rows = op.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[(r.doc_id, r.size)]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= max(1, min(r.size for r in rows if r.size and source[(r.doc_id, r.size)] == s))
    again = op.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in rows) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_buckets_pick_the_planned_number(spark, monkeypatch):
    monkeypatch.setattr(op, "RANKED", 5)
    docs = spark.createDataFrame([(i, "one two three", "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    rows = op.mix(docs).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.doc_id % 2] += r.taken
    for r in rows:
        assert abs(by[r.doc_id % 2] - r.target) <= 3


def test_fit_budget_is_exact_on_small_cases():
    rng = random.Random(5)
    for _ in range(200):
        lengths = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        total = sum(n * c for n, c in lengths.items())
        budget = rng.randrange(0, total + 1)
        got = op.fit_budget(lengths, budget)
        assert all(0 <= got.get(n, 0) <= c for n, c in lengths.items())
        sums = {sum(n * k for n, k in zip(lengths, ks)) for ks in itertools.product(*[range(c + 1) for c in lengths.values()])}
        nearest = min(abs(s - budget) for s in sums)
        assert abs(sum(n * k for n, k in got.items()) - budget) == nearest


def test_large_budget():
    lengths = {n: 50 for n in range(100, 4000, 7)}
    total = sum(n * c for n, c in lengths.items())
    got = op.fit_budget(lengths, total // 3)
    assert sum(n * k for n, k in got.items()) == total // 3


def test_empty(spark, empty_docs):
    assert op.mix(empty_docs).count() == 0


def test_fit_budget_is_exact_on_long_lengths():
    """1,000 random tables with lengths to 20,000 words, held against every sum that can be made."""
    rng = random.Random(5)
    for _ in range(1000):
        lengths = {rng.randint(1, rng.choice([5, 100, 2000, 20_000])): rng.randint(1, rng.choice([1, 3, 8])) for _ in range(rng.randint(1, 12))}
        total = sum(n * c for n, c in lengths.items())
        budget = rng.randint(1, total)
        made = np.zeros(total + 1, bool)
        made[0] = True
        for n, c in lengths.items():
            for _ in range(c):
                more = made.copy()
                more[n:] |= made[:-n]
                made = more
        sums = np.flatnonzero(made)
        want = min(sums.tolist(), key=lambda s: (abs(s - budget), s))
        got = op.fit_budget(lengths, budget)
        assert sum(n * c for n, c in got.items()) == want and all(0 <= c <= lengths[n] for n, c in got.items())


def test_fit_budget_on_many_documents():
    assert sum(n * c for n, c in op.fit_budget({n: 1000 for n in range(1, 20_001)}, 10**11 + 7).items()) == 10**11 + 7
    got = op.fit_budget({7 * n: 3 for n in range(1, 3000)}, 10**6 + 3)
    assert sum(n * c for n, c in got.items()) == 10**6 + 6  # the nearest multiple of seven
