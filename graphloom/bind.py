"""Graph and collection views over the star-schema tables (see FIXTURES.md part 3).

A line item is one touch of a file (part) by a commit (order). The same pair can occur more than
once, so touches are merged on their key: the smallest line number carries the change type.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.functions.scratch import exists, fingerprint, kept_dir, rename, shuffles_removed
from graphloom.operators import inverted
from graphloom.session import table


def change_letter(flag):
    """Return flags as change types: A created, N modified, R deleted."""
    return F.when(flag == "A", "A").when(flag == "N", "M").when(flag == "R", "D")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("hash"),
        F.col("o_custkey").alias("author"),
        F.col("o_orderdate").alias("ts"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("path"),
        F.col("p_brand").alias("dir"),
        F.col("p_type").alias("language"),
        F.col("p_size").alias("loc"),
        F.col("p_name").alias("name"),
    )


def raw_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hash"),
        F.col("l_partkey").alias("path"),
        F.col("l_linenumber").alias("line"),
        change_letter(F.col("l_returnflag")).alias("change_type"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("additions"),
    )


#: Rows of a task that sorts or groups touches.
TASK_ROWS = 500_000


def tasks(rows: DataFrame) -> int:
    """The number of tasks for some rows, so that what a task holds does not grow with the table."""
    return max(1, -(-rows.count() // TASK_ROWS))


def touches(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """One edge per (commit, file): first change type by line number, latest time, summed additions; with
    since or until, those of a window of time.

    The merge shuffles all line items, so it is done once for a state of the table (its length and time of
    change), as an ingestion would: the edges are written to the shared folder by month, first under a name of
    their own, and every later query and application reads them there. A window prunes months before it filters.
    """
    source = f"{sf_dir}/lineitem.parquet"
    kept = f"{kept_dir(spark)}/touched-{fingerprint(spark, source)}"
    if not exists(spark, f"{kept}/_SUCCESS"):
        begun, raw = f"{kept}-{uuid.uuid4().hex}", raw_touches(spark, sf_dir)
        merged = _merged(raw.repartition(tasks(raw), "hash", "path")).withColumn("month", F.date_format("ts", "yyyy-MM"))
        with shuffles_removed(spark):
            merged.hint("rebalance", "month").sortWithinPartitions("month", "ts").write.mode("overwrite").partitionBy("month").parquet(begun)
        rename(spark, begun, kept)
    rows = spark.read.schema(_schema(spark, sf_dir)).parquet(kept)
    if since:
        rows = rows.where((F.col("month") >= since[:7]) & (F.col("ts") >= F.lit(since).cast("timestamp")))
    if until:
        rows = rows.where((F.col("month") <= until[:7]) & (F.col("ts") <= F.lit(until).cast("timestamp")))
    return rows.drop("month")


def _schema(spark: SparkSession, sf_dir: str) -> StructType:
    return StructType([*_merged(raw_touches(spark, sf_dir)).schema.fields, StructField("month", StringType())])


def _merged(raw: DataFrame) -> DataFrame:
    return (
        raw
        .groupBy("hash", "path")
        .agg(
            F.min(F.struct("line", "change_type"))["change_type"].alias("change_type"),
            F.max("ts").alias("ts"),
            F.sum("additions").alias("additions"),
        )
    )


def search_index(spark: SparkSession, sf_dir: str) -> inverted.Index:
    """Files, requirements, commits and chunks with their texts in one inverted index, built once for a state of
    the tables."""
    parts = {
        "File": ("part", "p_partkey", ["p_name", "p_type"]), "Requirement": ("supplier", "s_suppkey", ["s_name"]),
        "GitCommit": ("orders", "o_orderkey", ["o_orderpriority"]), "Chunk": ("documents", "doc_id", ["text"]),
    }
    rows = [
        table(spark, sf_dir, name).select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), F.concat_ws(" ", *columns).alias("text"))
        for label, (name, key, columns) in parts.items()
    ]
    state = "-".join(fingerprint(spark, f"{sf_dir}/{name}.parquet")[:12] for name, _, _ in parts.values())
    return inverted.build(reduce(DataFrame.unionAll, rows), f"{kept_dir(spark)}/index-{state}")


TOUCHED_SQL = """touched AS (
  SELECT l_orderkey AS hash, l_partkey AS path,
         substr(min(l_linenumber || CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' WHEN 'R' THEN 'D' END), 2) AS change_type,
         max(l_shipdate) AS ts, sum(l_quantity) AS additions
  FROM lineitem GROUP BY 1, 2)"""


def sprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar quarters that have commits: number, first and last day."""
    day = F.date_trunc("quarter", "ts").cast("date")
    return (
        commits(spark, sf_dir).select(day.alias("start")).distinct()
        .select(
            F.concat_ws("-", F.year("start"), F.quarter("start")).alias("number"),
            "start",
            F.date_sub(F.add_months("start", 3), 1).alias("end"),
        )
    )


SPRINTS_SQL = """sprints AS (SELECT year(q) || '-' || quarter(q) AS number, q AS "start", CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end"
  FROM (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q FROM orders))"""
