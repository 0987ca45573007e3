"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(parts: int, which: int) -> Column:
    """crc32 of the id as text leaves the remainder `which`; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == which, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: int, seed: int = 11):
    """At most per_class labelled documents of either class, chosen by a hash of the id, with columns
    doc_id, text, y (0 or 1) and weight (rows of the class for each row chosen).

    Ids that are null or not learnable are left out, as are labels other than 0 and 1; an id that
    is labelled both ways counts as the label it has more often, 1 if equal. The chosen ids are at
    most 2 * per_class, which bounds what is broadcast. An id with several rows counts once, with its
    smallest text, so the rows returned are at most 2 * per_class as well.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learnable)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))
    )
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y, n in sizes.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class)
        part = part.withColumn("weight", F.lit(n / min(n, per_class)))
        chosen = part if chosen is None else chosen.unionAll(part)
    if chosen is None:
        chosen = known.withColumn("weight", F.lit(1.0)).limit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("weight").alias("weight"))
