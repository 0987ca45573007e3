import random

from pyspark.sql import functions as F

from graphloom.llm import op6_edit_counts as op
from graphloom.llm import tokens


def encoder():
    with open(tokens.BYTE_BPE, "rb") as f:
        return tokens.encoder(f.read())


def test_tree_equals_full_encoding_after_every_edit():
    encode, rng = encoder(), random.Random(1)
    letters = "ab c  d\n'se\t9.,é日 "
    for _ in range(120):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 50, 600, 3000])))
        tree = op.CountTree(text, encode)
        assert tree.total == len(encode.encode_ordinary(text))
        for _ in range(8):
            at, removed = rng.randrange(len(text) + 1), rng.choice([0, 1, 5, 400])
            inserted = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 700])))
            tree.edit(at, removed, inserted)
            text = text[:at] + inserted + text[at + removed :]
            assert "".join(tree.leaves) == text and tree.total == len(encode.encode_ordinary(text))


def test_only_the_region_is_encoded_again():
    encode = encoder()
    text = "some words that go on and on " * 3000
    tree = op.CountTree(text, encode)
    assert tree.edit(40_000, 3, "new") < 8 * op.LEAF


def test_table_of_edits(spark, edge_docs, empty_docs):
    encode = encoder()
    edits = spark.createDataFrame([(1, 2, 0, 5, "Plain"), (1, 1, 5, 1, "  "), (5, 1, 100000, 9, " end"), (2, 1, 0, 0, "born"), (None, 1, 0, 1, "x")], "doc_id long, seq int, at int, removed int, inserted string")
    vocabulary = tokens.vocabulary(spark)
    rows = op.count_with_edits(op.attach_edits(edge_docs, edits), F.col("edits"), vocabulary).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens_after == len(encode.encode_ordinary("Plain  words stand here and there"))
    assert by[5].n_tokens_after == len(encode.encode_ordinary("plain words stand here and there end"))
    assert by[2].n_tokens == 0 and by[2].n_tokens_after == len(encode.encode_ordinary("born"))
    assert by[6].n_tokens == by[6].n_tokens_after and by[6].n_encoded == 0
    assert op.count_with_edits(empty_docs, op.revision(F.col("text")), vocabulary).count() == 0


def test_query_edits_equal_brute_force(spark, near_docs):
    encode = encoder()
    text = {r.doc_id: r.text for r in near_docs.collect()}
    for r in op.count_with_edits(near_docs, op.revision(F.col("text")), tokens.vocabulary(spark)).collect():
        t = text[r.doc_id]
        n, u = len(t), t[: len(t) // 3] + " (revised)" + t[len(t) // 3 :]
        at = min(2 * n // 3, len(u))
        u = u[:at] + u[at + 40 :]
        at = min(n, len(u))
        u = u[:at] + "\nEnd of revision 2." + u[at:]
        assert (r.n_tokens, r.n_tokens_after) == (len(encode.encode_ordinary(t)), len(encode.encode_ordinary(u)))


def test_growth_and_texts_without_spaces_encode_the_region_alone():
    """After a long insertion only what was inserted and its leaf are encoded; marks part a text without spaces."""
    class Counting:
        def __init__(self):
            self.inner, self.chars = encoder(), 0

        def encode_ordinary(self, text):
            self.chars += len(text)
            return self.inner.encode_ordinary(text)

    for text in ("some words that go on and on " * 1500, "日本語の文章がつづく。次の文も、" * 1700):
        counting = Counting()
        tree = op.CountTree(text, counting)
        for at, inserted in ((20_000, "new words, " * 800), (9_000, "ん")):
            counting.chars = 0
            said = tree.edit(at, 0, inserted)
            assert said == counting.chars <= len(inserted) + 4 * op.LEAF
            text = text[:at] + inserted + text[at:]
        assert "".join(tree.leaves) == text and tree.total == len(encoder().encode_ordinary(text))


def test_cuts_are_safe():
    encode, rng = encoder(), random.Random(9)
    letters = "ab'stl  1 2.,-\n\té日。\u00a0\u2003🙂\x1c"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(2, 14)))
        whole = encode.encode_ordinary(text)
        for found in op._CUT.finditer(text):
            at = found.start()
            assert encode.encode_ordinary(text[:at]) + encode.encode_ordinary(text[at:]) == whole, (text, at)


def test_kept_trees_follow_batches_of_edits(spark, edge_docs):
    """Two batches over a table of trees: touched rows equal a full encoding, the others are not encoded."""
    encode, vocabulary = encoder(), tokens.vocabulary(spark)
    trees = op.build_trees(edge_docs, vocabulary)
    schema = "doc_id long, seq int, at int, removed int, inserted string"
    first = spark.createDataFrame([(1, 1, 0, 5, "Plain"), (6, 1, 5003, 0, "a longer text " * 40)], schema)
    second = spark.createDataFrame([(6, 1, 4990, 30, "!")], schema)
    once = op.apply_edits(op.attach_edits(trees, first), vocabulary).cache()
    twice = op.apply_edits(op.attach_edits(once, second), vocabulary).collect()
    for r in twice:
        assert r.n_tokens == sum(r.tokens) == len(encode.encode_ordinary(r.text or "")) and sum(r.chars) == len(r.text or "")
        assert (r.n_encoded > 0) == (r.doc_id == 6)
    assert {r.doc_id for r in once.collect() if r.n_encoded} == {1, 6} and set(edge_docs.columns) <= set(once.columns)
    assert [r.text for r in twice if r.doc_id == 2] == [None]
