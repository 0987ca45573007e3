import random
import re
from collections import Counter, defaultdict

from graphloom.llm import op11_divergence as op


def brute(rows, least=3, ranks=200):
    """Every term of every group by the formula, no vectors."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    within, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        within[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang in within:
        kept = [t for t, n in within[lang].items() if n >= least]
        sources = sorted({s for g, s, _ in rows if g == lang}, key=str.encode)
        every = Counter()
        for s in sources:
            every.update({t: counts[lang, s][t] for t in kept})
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        shares, whole = {s: p(counts[lang, s]) for s in sources}, p(every)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(shares[s][t], whole[t])) for t in kept if counts[lang, s][t] and shares[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found) if part == "pair" or k < ranks}
    return out


def result(df):
    rows = df.collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def corpus(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("Wort", "été", "straße", "x", "日本") for b in "abcdefgh"]
    rows = []
    for k in range(160):
        source = rng.choice(["s1", "s1", "s1", "S2", "é3", None])
        text = " ".join(rng.choice(words[: rng.choice([5, 40])]) + rng.choice(["", ",", "1", "_"]) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.choice(["de", "en", None]), source, text or None, k))
    return spark.createDataFrame(rows + [("en", "mute", "", 1), ("xx", "a", "once", 2), ("xx", "b", None, 3)], "lang string, source string, text string, term long").repartition(3)


def test_equals_brute_force(spark, monkeypatch):
    docs = corpus(spark)
    want = brute([(r.lang, r.source, r.text) for r in docs.collect()])
    assert result(op.audit(docs)) == want
    monkeypatch.setattr(op, "BLOCK", 3)
    monkeypatch.setattr(op, "COUNTED", 20)
    assert result(op.audit(docs)) == want


def test_ranks_with_ties(spark):
    """Terms of one vector tie: the ranks go by the bytes of the term, and no vector that may reach them is lost."""
    rows = [("en", f"s{k % 3}", " ".join(f"t{chr(97 + i // 5)}{chr(97 + i % 5)}" for i in range(k % 3, 25, 2))) for k in range(12)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for ranks in (1, 4, 200):
        assert result(op.audit(docs, ranks=ranks)) == brute(rows, ranks=ranks)


def test_edges(spark, edge_docs, empty_docs):
    assert op.audit(empty_docs).collect() == []
    assert result(op.audit(edge_docs, least=1)) == brute([(r.lang, r.source, r.text) for r in edge_docs.collect()], least=1)


def test_shares_are_exact(spark):
    big = 9_000_000_000_000_000
    row = spark.createDataFrame([(big, 7, 11)], "n long, size long, terms long")
    assert row.select(op.share(row.n, row.size + big, row.terms)).first()[0] == 1 + 10**9 * (big + 1) // (big + 18)
