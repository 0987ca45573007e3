"""Derived edges kept up to date: a watermark per derivation, signed evidence, versions.

What is kept is not the edge but its evidence, counted: one row for each (src, dst, confidence, time) with
the number of times it was seen. New evidence counts up, evidence that went counts down, and rows at zero
vanish; edges (noisy-or, first and last time, number) follow from the counts, so an update never needs what was
read before. Every update writes a new version beside the old one, with the watermark up to which the source
was read; the newest complete version counts, so a broken update leaves the last one in force.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scratch import exists

EVIDENCE = "src long, dst long, confidence double, ts timestamp, n long"
MARK = "watermark timestamp"


@dataclass(frozen=True)
class Derivation:
    """The kept state of one derivation below a folder."""

    spark: SparkSession
    path: str

    def version(self) -> int:
        """The newest complete version, 0 if there is none."""
        number = 0
        while exists(self.spark, f"{self.path}/v{number + 1}/mark/_SUCCESS"):
            number += 1
        return number

    def evidence(self) -> DataFrame:
        number = self.version()
        if not number:
            return self.spark.createDataFrame([], EVIDENCE)
        return self.spark.read.schema(EVIDENCE).parquet(f"{self.path}/v{number}/evidence")

    def watermark(self):
        """The time up to which the source was read; None before the first update."""
        number = self.version()
        return self.spark.read.schema(MARK).parquet(f"{self.path}/v{number}/mark").first()[0] if number else None

    def fresh(self, source: DataFrame, ts: str) -> DataFrame:
        """Rows of the source after the watermark: a plain comparison that reaches the scan."""
        mark = self.watermark()
        return source if mark is None else source.where(F.col(ts) > F.lit(mark))

    def update(self, added: DataFrame, gone: DataFrame | None = None) -> None:
        """Merges evidence (src, dst, confidence, ts) that came, and takes back what went. The watermark moves to
        the latest time that came; late rows can be given as `added` at any time and do not move it back."""
        number, before = self.version() + 1, self.watermark()
        rows = lambda df, sign: df.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("confidence").cast("double").alias("confidence"), F.col("ts").cast("timestamp").alias("ts"), F.lit(sign).cast("long").alias("n"))
        signed = self.evidence().unionAll(rows(added, 1))
        signed = signed if gone is None else signed.unionAll(rows(gone, -1))
        merged = signed.groupBy("src", "dst", "confidence", "ts").agg(F.sum("n").alias("n")).where("n <> 0")
        merged.write.mode("overwrite").parquet(f"{self.path}/v{number}/evidence")
        latest = added.agg(F.max(F.col("ts").cast("timestamp")).alias("watermark")).select(F.greatest("watermark", F.lit(before).cast("timestamp")).alias("watermark"))
        latest.write.mode("overwrite").parquet(f"{self.path}/v{number}/mark")

    def edges(self) -> DataFrame:
        """src, dst, confidence (1 - product of 1 - c), evidence (number), first_ts, last_ts."""
        held = self.evidence().where("n > 0")
        return held.groupBy("src", "dst").agg(
            (1 - F.product(F.pow(1 - F.col("confidence"), F.col("n")))).alias("confidence"), F.sum("n").alias("evidence"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
        )
