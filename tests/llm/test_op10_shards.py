from zlib import crc32

import numpy as np

from graphloom.llm import op10_shards as op
from graphloom.llm import tokens


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 64, 65, 1000, 4097):
        out = op.feistel(np.arange(n), n, 7)
        assert sorted(out.tolist()) == list(range(n))
    assert op.feistel(np.arange(1000), 1000, 7).tolist() != op.feistel(np.arange(1000), 1000, 8).tolist()


def test_slots_are_dense_and_payloads_round_trip(spark, edge_docs, tmp_path):
    vocabulary = tokens.vocabulary(spark)
    ordered = op.training_order(edge_docs, vocabulary, length=64, shard_rows=16).cache()
    rows = ordered.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 16 and r.row == r.slot % 16 and len(r.payload) == 128 for r in rows)
    encode = tokens.encoder(vocabulary.value)
    per = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.part)):
        per.setdefault(str(r.doc_id), []).extend(np.frombuffer(r.payload, "<u2")[: r.n_tokens].tolist())
    for d in edge_docs.where("doc_id <> 5").collect():
        ids = per[str(d.doc_id)]
        assert ids[-1] == tokens.END_OF_TEXT and encode.decode(ids[:-1]) == (d.text or "")
    folder = op.write_shards(edge_docs, vocabulary, str(tmp_path), length=64, shard_rows=16)
    index = {r.slot: r for r in spark.read.parquet(f"{folder}/index").collect()}
    want = {r.slot: bytes(r.payload) for r in rows}
    assert {s: (r.doc_id, r.part, r.n_tokens) for s, r in index.items()} == {r.slot: (r.doc_id, r.part, r.n_tokens) for r in rows}
    for slot, r in index.items():
        (file,) = (tmp_path / folder / "shards").glob(f"volume=*/shard={r.shard}/*.txt")
        with open(file, "rb") as f:
            f.seek(r.row * 129)
            record = f.read(129)
        assert record == want[slot] + b"\n" and r.crc == crc32(want[slot])
    assert {r.slot: bytes(r.payload) for r in op.read_shards(spark, folder).collect()} == want
    half = len(rows) // 2
    assert sorted(r.slot for r in op.read_shards(spark, folder, half).collect()) == list(range(half, len(rows)))


def test_an_order_is_written_once_and_never_mixed(spark, near_docs, tmp_path):
    vocabulary = tokens.vocabulary(spark)
    write = lambda docs, **kw: op.write_shards(docs, vocabulary, str(tmp_path), length=32, shard_rows=16, **kw)
    stamps = lambda folder: {p.name: p.stat().st_mtime_ns for p in (tmp_path / folder).rglob("*") if p.is_file()}
    folder = write(near_docs)
    before = stamps(folder)
    assert write(near_docs.repartition(5)) == folder and stamps(folder) == before
    other, fewer = write(near_docs, key=2), write(near_docs.where("doc_id > 10"))
    assert len({folder, other, fewer}) == 3 and stamps(folder) == before
    (tmp_path / folder / "manifest" / "_SUCCESS").unlink()  # as if it broke before the end
    assert write(near_docs) == folder and stamps(folder) != before
    (tmp_path / folder / "manifest" / "_SUCCESS").unlink()
    (tmp_path / folder / "shards" / "volume=1" / "_SUCCESS").unlink()
    before = stamps(folder)
    assert write(near_docs) == folder
    after = stamps(folder)
    shard_files = lambda v: {p.name for p in (tmp_path / folder / "shards" / f"volume={v}").rglob("*.txt")}
    assert all(after[n] == before[n] for v in (0, 2, 3) for n in shard_files(v)) and not shard_files(1) & set(before)
    a, b = ([bytes(r.payload) for r in op.read_shards(spark, f).orderBy("slot").collect()] for f in (folder, other))
    assert sorted(a) == sorted(b) and a != b


def test_order_does_not_follow_the_layout(spark, near_docs):
    vocabulary = tokens.vocabulary(spark)
    a = {(r.doc_id, r.part): r.slot for r in op.training_order(near_docs, vocabulary, length=32).collect()}
    b = {(r.doc_id, r.part): r.slot for r in op.training_order(near_docs.repartition(13), vocabulary, length=32).collect()}
    assert a == b


def test_empty(spark, empty_docs, tmp_path):
    assert op.training_order(empty_docs, tokens.vocabulary(spark)).count() == 0
    folder = op.write_shards(empty_docs, tokens.vocabulary(spark), str(tmp_path))
    assert spark.read.parquet(f"{folder}/index").count() == 0 and op.read_shards(spark, folder).count() == 0
