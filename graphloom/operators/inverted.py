"""A kept inverted index with BM25 ranking.

Postings are written once: one row a term and document, with the term's frequency and its weight (the part
of BM25 that does not depend on the query), in buckets by hash of the term and, within a bucket, by term
and range of documents. Documents are dealt into ranges by length, as short ones weigh more, and for each
term and range the largest weight is kept. A search reads the buckets of its own terms alone. It adds up
the largest weights to a bound for each range, scores the ranges with the highest bounds, and then only those
ranges whose bound reaches the k-th best score found; documents elsewhere cannot get there.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scratch import cut, exists, join_checked, rename, shuffles_removed

#: Fixed values of the ranking; buckets of terms, ranges of documents, ranges that are scored first.
K1, B = 1.2, 0.75
BUCKETS, RANGES, FIRST = 64, 32, 3


#: Tables of an index.
SCHEMAS = {
    "postings": "term string, span int, label string, id string, tf long, len int, weight double, bucket int",
    "tops": "term string, span int, top double, df long, bucket int",
    "docs": "label string, id string, len int, span int",
    "about": "n long, mean double, cuts array<int>",
}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """Where an index lies. postings: term, label, id, tf, len, weight, span, by bucket; terms: term, df, by bucket;
    tops: term, span, top, by bucket; docs: label, id, len, span; about: documents, mean length."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def of(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of some terms: the filter on buckets prunes folders, that on terms row groups."""
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]
        return self.table(name).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def build(docs: DataFrame, path: str) -> Index:
    """Indexes docs (label, id, text); rows without tokens are left out. An index that is whole at path is
    taken as it is. Large buckets (those of frequent terms) are split over files."""
    spark = docs.sparkSession
    if not exists(spark, f"{path}/postings/_SUCCESS"):
        begun = f"{path}-{uuid.uuid4().hex}"
        _write(docs, Index(spark, begun))
        rename(spark, begun, path)
    return Index(spark, path)


def _write(docs: DataFrame, index: Index) -> None:
    path = index.path
    with shuffles_removed(index.spark):
        body = _whole(docs).select("label", "id", tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
        # Rows without tokens go by what comes out: a filter or an inner inline() would make the tokens again.
        lengths = cut(body.select("label", "id", "len"), "lengths").where("len > 0")
        # Ranges by length: one cut for each share of the documents, a list of fixed length.
        cuts = lengths.agg(F.percentile_approx("len", [k / RANGES for k in range(1, RANGES)], 10_000).alias("cuts"), F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
        cuts.select("n", "mean", F.coalesce("cuts", F.array().cast("array<int>")).alias("cuts")).write.parquet(f"{path}/about")
        about = F.broadcast(index.table("about"))  # one row
        spanned = lambda rows: rows.withColumn("span", F.size(F.filter("cuts", lambda c: c < F.col("len"))))
        spanned(lengths.join(about)).select("label", "id", "len", "span").write.parquet(f"{path}/docs")
        counted = body.select("label", "id", "len", F.inline_outer(_counts(F.col("t")))).where("term IS NOT NULL")
        # Only what cannot be told from a posting's length moves to its bucket; range and weight follow there.
        dealt = counted.select(_bucket(F.col("term")).alias("bucket"), "term", "label", "id", "tf", "len").hint("rebalance", "bucket")
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        posted = spanned(dealt.join(about)).select("bucket", "term", "span", "label", "id", "tf", "len", weight.alias("weight"))
        posted.sortWithinPartitions("bucket", "term", "span").write.partitionBy("bucket").parquet(f"{path}/postings")
        tops = index.table("postings").groupBy("bucket", "term", "span").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("df"))
        tops.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/tops")


def _whole(docs: DataFrame) -> DataFrame:
    """docs with one row an id: the texts of ids that repeat are put together, the others stay where they are."""
    rows = docs.select("label", F.col("id").cast("string").alias("id"), "text")
    again = cut(rows.groupBy("label", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "id"), "again")
    if again.isEmpty():
        return rows
    joined = join_checked(rows, again, ["label", "id"], "left_semi").groupBy("label", "id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    return join_checked(rows, again, ["label", "id"], "left_anti").unionAll(joined)


def _counts(words: Column) -> Column:
    """Structs of term and tf (how often it stands there) of a list: runs of the sorted list, so that terms of a
    document are counted where it lies."""
    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(w) + 1))
        return F.transform(F.array(starts), lambda s: F.zip_with(s, ends(s), lambda a, b: F.struct(F.get(w, a - 1).alias("term"), (b - a).cast("long").alias("tf"))))[0]

    return F.transform(F.array(F.sort_array(words)), runs)[0]


def _rarity(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _scored(index: Index, terms: list[str], spans: list[int], rarity: DataFrame) -> DataFrame:
    rows = index.of("postings", terms).where(F.col("span").isin(spans)).join(F.broadcast(rarity), "term")  # a row for each term asked for
    return rows.groupBy("label", "id").agg(F.round(F.sum(F.col("weight") * F.col("rarity")), 9).alias("score"), F.count(F.lit(1)).alias("matched"), F.sum("tf").alias("hits"))


def search(index: Index, text: str, k: int = 10) -> DataFrame:
    """label, id, score (to nine decimals, as sums of doubles depend on their order), matched (terms), hits of
    the k best documents by BM25 over the distinct terms of text; ties by label and id. No term in the index gives no rows.

    The driver holds the terms asked for, RANGES numbers, and one score."""
    asked = index.spark.createDataFrame([(text,)], "q string").select(F.array_distinct(tokens(F.col("q")))).first()[0]
    order = [F.desc("score"), "label", "id"]
    tops = index.of("tops", asked)
    rarity = tops.groupBy("term").agg(F.sum("df").alias("df")).join(F.broadcast(index.table("about").select("n"))).select("term", _rarity(F.col("df"), F.col("n")).alias("rarity"))
    bounds = tops.join(F.broadcast(rarity), "term").groupBy("span").agg(F.sum(F.col("top") * F.col("rarity")).alias("bound"))
    spans = [(r.span, r.bound) for r in bounds.orderBy(F.desc("bound"), "span").collect()]
    first = [s for s, _ in spans[:FIRST]]
    least = _scored(index, asked, first, rarity).orderBy(*order).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    rest = [s for s, b in spans if s in first or least.n < k or b >= least.least - 1e-6]
    return _scored(index, asked, rest, rarity).orderBy(*order).limit(k)


def matches(index: Index, terms: list[str]) -> DataFrame:
    """label, id, matched, hits: how many of the terms each document has, and how often; every document with one."""
    rows = index.of("postings", [t.lower() for t in terms])
    return rows.groupBy("label", "id").agg(F.count(F.lit(1)).alias("matched"), F.sum("tf").alias("hits"))
