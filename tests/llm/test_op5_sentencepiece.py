import random
import struct

import sentencepiece

from graphloom.llm import op5_sentencepiece as op


def test_equals_the_library_and_round_trips(spark, edge_docs):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab ce.,\n日éñ-'") for _ in range(rng.choice([3, 80, 400]))) for _ in range(60)]
    docs = edge_docs.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    library = sentencepiece.SentencePieceProcessor(model_file=op.MODEL)
    for head in (0, 40, op.HEAD):  # rare units in tasks, a mixture, all through the lattice
        encoded = op.encode(docs, head=head)
        want = sorted((str(r.doc_id), str(None if r.text is None else library.encode(r.text))) for r in docs.collect())
        got = encoded.collect()
        assert sorted((str(r.doc_id), str(r.ids)) for r in got) == want
        assert all(r.n_pieces == len(r.ids or []) for r in got)
    back = op.decode(encoded).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in back) == sorted((str(r.doc_id), str(r.text)) for r in docs.collect())


def _message(number, payload):
    return bytes([number << 3 | 2]) + _varint(len(payload)) + payload


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram_model(path):
    """A hand-written unigram model: no training."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rng = random.Random(4)
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "bca", "▁c", "cc"]
    pieces += [(w, -rng.uniform(1, 9), 1) for w in words]
    raw = b"".join(_message(1, _message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in pieces)
    raw += _message(2, b"\x18\x01") + _message(3, _message(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")
    path.write_bytes(raw)
    return str(path)


def test_unigram_viterbi_equals_the_library(spark, tmp_path):
    path = unigram_model(tmp_path / "hand.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    texts = list({" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(4)) for _ in range(50)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for head in (0, 1000):
        for r in op.encode(docs, path=path, head=head).collect():
            assert r.ids == library.encode(texts[r.doc_id])


def test_empty(spark, empty_docs):
    assert op.encode(empty_docs).count() == 0


def test_round_trip_says_what_came_back(spark, edge_docs, empty_docs):
    rows = op.round_trip(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.restored is (None if r.ids is None else True) for r in rows)
    marks = spark.createDataFrame([(1, "a▁b  c\n"), (2, " lead"), (3, "▁"), (4, "\x01\u2028🙂")], "doc_id long, text string")
    assert all(r.restored for r in op.round_trip(marks).collect())
    assert op.round_trip(empty_docs).count() == 0
