"""From raw documents to a tokenised training corpus, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the
shared folder and reads it again as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scratch import cut, discard, mark
from graphloom.llm import op3_mixing, op4_minhash, op5_sentencepiece, op7_toxicity, op9_surrogates
from graphloom.llm.labelled import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5. Every row is judged by its own text,
    repeated ids too; null and empty texts have a score like any other. An empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = op7_toxicity.train(docs, labels, ~held_out(5, 0))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return op7_toxicity.score(row, machine).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id (five-word shingles,
    similarity 0.8). Rows decide, not ids: an id that is repeated with another text keeps that text, and
    of rows repeated in full one stays. Rows with a null id or without words all stay; an empty table
    stays empty."""
    return op4_minhash.one_of_each(docs).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by surrogates; no document is dropped."""
    return op9_surrogates.pseudonymise(docs, count=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice. Rows decide, not ids: each row goes
    through the mix with all its columns, rows that share a doc_id or have none too. Rows without words
    are taken 0 times; an empty table stays empty."""
    plan = op3_mixing.mix(docs, carry=True).where("taken > 0")
    copies = F.sequence(F.lit(1).cast("long"), (F.col("taken") / F.col("size")).cast("long"))
    return plan.select("row", F.explode(copies).alias("copy")).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every row of the mix, repeats included; null and empty texts have no
    pieces. An empty table gives an empty result."""
    return op5_sentencepiece.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("pii_surrogates", replace_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. When a stage is written, what the stages before it left in the shared
    folder is deleted; the result's own table stays until sweep()."""
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        discard(spark, begun)
    return docs


#: Training, MinHash signatures and BPE merges have no SQL form; tests/llm/test_pipeline.py holds the
#: stages against brute force.
ORACLE_SQL = None
