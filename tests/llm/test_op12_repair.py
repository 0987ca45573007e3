import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import op12_repair as op

SCHEMA = "conv_id long, turn long, role string, text string"
FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """rows of (role, text, must go, truncated) -> (cost, audit, repaired): all edits one after the other, the best
    of each state kept."""
    best = {"": (0, "", ())}

    def offer(known, state, found):
        if state not in known or found[:2] < known[state][:2]:
            known[state] = found

    def inserted(known):
        for _ in range(3):
            for state, (cost, audit, text) in list(known.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in FOLLOWS:
                        offer(known, FOLLOWS[state, role[0]], (cost + 5, audit + "I", (*text, f"{role}:")))

    for role, text, gone, cut in rows:
        inserted(best)
        after = {}
        for state, (cost, audit, done) in best.items():
            offer(after, state, (cost + 2, audit + "D", done))
            if not gone:
                if (state, role[:1]) in FOLLOWS:
                    offer(after, FOLLOWS[state, role[:1]], (cost + 5 * cut, audit + "K", (*done, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if (state, other[0]) in FOLLOWS:
                        offer(after, FOLLOWS[state, other[0]], (cost + 1 + 5 * cut, audit + "R", (*done, f"{other}:{text}")))
        best = after
    inserted(best)
    cost, audit, text = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()


def brute(rows):
    conversations = defaultdict(list)
    for r in damaged(rows):
        conversations[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        kept = sorted(conversations[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        count, seen, marked = Counter(), set(), []
        for _, _, role, text in kept:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[1] for r in kept if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, *cheapest(marked))
    return out


def result(df):
    rows = df.collect()
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def talks(n=150, seed=4):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "Is it so?", "cut off", "", " \n", None, f"number {rng.randrange(9)}!", "end. \x0b\x0c", "not "])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn * 2, None]), role, text))
    return rows


def test_equals_brute_force(spark):
    rows = talks()
    assert result(op.repair(op.damage(spark.createDataFrame(rows, SCHEMA).repartition(3)))) == brute(rows)


@pytest.mark.parametrize("long, piece", [(2, 3), (7, 1000), (4, 1)])
def test_long_way_gives_the_same(spark, long, piece):
    """Conversations beyond a number of turns: rows to a table, repeats by grouping, costs piece by piece."""
    rows = talks(40, seed=9)
    assert result(op.repair(op.damage(spark.createDataFrame(rows, SCHEMA)), long, piece)) == brute(rows)


def test_tensor_equals_one_by_one():
    rng = np.random.default_rng(1)
    flags = [rng.integers(0, 4, n) + rng.choice([0, 0, 4, 8, 16], n) for n in rng.integers(0, 40, 300)]
    for f, (cost, audit) in zip(flags, op.repair_all(flags)):
        rows = [("suax"[x & 3], "", bool(x & (op.BLANK | op.REPEATED)), bool(x & op.CUT)) for x in f]
        assert (cost, audit.decode()) == cheapest(rows)[:2] == tuple(x if isinstance(x, int) else x.decode() for x in op.repair_long(f, 7))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert result(op.query(spark, "/root/testdata/sf0.01")) == brute([tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()])


def test_edges(spark):
    assert op.repair(op.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    gone = next(i for i in range(100, 999) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    long_text = "x" * 3_000_000 + "."
    rows = [(gone, 1, "user", "Never seen."), (None, None, None, None), (7, None, "user", long_text), (7, 2, "assistant", "Sure."), (7, 2, "assistant", "Sure.")]
    clash = spark.createDataFrame([(*r, 1, "x", True) for r in rows], SCHEMA + ", flags int, audit string, dropped boolean")
    found = result(op.repair(op.damage(clash)))
    assert found == brute(rows)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
