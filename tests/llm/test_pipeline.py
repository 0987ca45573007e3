import re
from collections import Counter

import sentencepiece

import corpus_pipeline
from graphloom.llm import op4_minhash, op5_sentencepiece, op7_toxicity
from graphloom.session import table
from tests.llm.test_op4_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut(stage(spark, before, SF), name)
        old, new = before.collect(), after.collect()
        if name != "sentencepiece":
            assert after.columns == columns
        if name == "toxicity":
            scored = op7_toxicity.classify(before, table(spark, SF, "labels")).where("predicted = 0")
            assert sorted(r.doc_id for r in new) == sorted(r.doc_id for r in scored.collect())
            assert len(toxic & {r.doc_id for r in new}) <= len(toxic) // 3 and len(new) >= 0.8 * len(old)
        if name == "minhash_near_dedup":
            want = brute([(r.doc_id, r.text) for r in old], 5)
            assert sorted(r.doc_id for r in new) == sorted(set(want.values()))
        if name == "pii_surrogates":
            assert Counter(r.doc_id for r in old) == Counter(r.doc_id for r in new)
            was = {r.doc_id: r.text for r in old}
            for r in new:
                found = re.findall(r"\S+@\S+|\b\d{16}\b|AKIA\w{16}", was[r.doc_id])
                assert not [x for x in found if x in r.text]
                assert found or re.search(r"\d|password", was[r.doc_id]) or r.text == was[r.doc_id]
        if name == "mixing":
            times, was = Counter(r.doc_id for r in new), {r.doc_id for r in old}
            assert set(times) <= was and max(times.values()) <= 2
        if name == "sentencepiece":
            library = sentencepiece.SentencePieceProcessor(model_file=op5_sentencepiece.MODEL)
            want = sorted((r.doc_id, library.encode(r.text)) for r in old)
            assert sorted((r.doc_id, r.ids) for r in new) == want
        before = after


def test_edges(spark, edge_docs, empty_docs, tmp_path):
    for docs in (edge_docs.select(*empty_docs.columns), empty_docs):
        folder = tmp_path / str(docs.count())
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.run(spark, str(folder)).columns == ["doc_id", "n_pieces", "ids"]


def test_rows_are_mixed_not_ids(spark):
    """Rows that share an id, or have none, are taken by what the mix decides about each of them."""
    schema, long_text = "doc_id long, text string, lang string, source string, n_chars long", "k1 k2 k3 k4 k5 k6 k7 k8"
    cases = [
        [(1, "one two three four", "en", "a", 18)] * 3 + [(2, "five six", "en", "b", 8), (3, None, None, None, None)],
        [(3, long_text, "en", "C", 1), (3, "", "de", "A", 2), (4, "x y", "en", "A", 3)],
        [(None, long_text, "en", "C", 1), (None, "p q r", "en", "C", 2), (None, "", "de", "A", 3), (None, " ", None, None, 4)],
    ]
    for rows in cases:
        docs = spark.createDataFrame(rows, schema)
        plan = Counter()
        for r in corpus_pipeline.op3_mixing.mix(docs, carry=True).collect():
            assert r.row.doc_id == r.doc_id and r.size == len((r.row.text or "").split())
            plan[tuple(r.row)] += r.taken // r.size if r.size else 0
        out = corpus_pipeline.mix_sources(spark, docs, SF)
        assert out.columns == docs.columns
        assert Counter(map(tuple, out.collect())) == +plan
        assert all((r.text or "").strip() for r in out.collect()) and any(r.text in (long_text, "one two three four") for r in out.collect())


def test_near_copies_go_by_row(spark):
    """A repeated id keeps its other text; of rows repeated in full one stays; the rest of the columns follow."""
    a, b, c = "one two three four five six seven", "a text of its own under the id that repeats", "this one is there two times in full"
    rows = [(1, a, "en", "s", 1), (7, a, "en", "s", 2), (7, b, "de", "t", 3), (2, c, "en", "s", 4), (2, c, "en", "s", 4), (None, a, "en", "s", 5), (9, None, "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.lang) for r in kept.collect()), key=str) == sorted([(1, a, "en"), (7, b, "de"), (2, c, "en"), (None, a, "en"), (9, None, "en")], key=str)


def test_dedup_defaults():
    assert op4_minhash.near_duplicates.__defaults__ == (5, 80)
