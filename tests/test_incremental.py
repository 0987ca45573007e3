"""Kept derivations: batches in turn equal one run, retraction, late rows, broken updates."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.operators.incremental import Derivation

SCHEMA = "src long, dst long, confidence double, ts timestamp"


@pytest.fixture()
def rows():
    rng = random.Random(6)
    return [(rng.randrange(4), rng.randrange(3), rng.choice([0.5, 0.7, 1.0]), datetime(2024, 1, 1) + timedelta(days=rng.randrange(40))) for _ in range(120)]


def brute(rows):
    by = defaultdict(list)
    for src, dst, c, ts in rows:
        by[src, dst].append((c, ts))
    return {k: (round(1 - math.prod(1 - c for c, _ in v), 9), len(v), min(t for _, t in v), max(t for _, t in v)) for k, v in by.items()}


def result(kept):
    return {(r.src, r.dst): (round(r.confidence, 9), r.evidence, r.first_ts, r.last_ts) for r in kept.edges().collect()}


def test_batches_equal_one_run_and_read_new_rows_only(spark, tmp_path, rows):
    source = f"{tmp_path}/source"
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    kept, cut = Derivation(spark, f"file://{tmp_path}/kept"), datetime(2024, 1, 20)
    assert kept.watermark() is None and kept.edges().count() == 0
    kept.update(kept.fresh(spark.read.parquet(source).where(F.col("ts") <= F.lit(cut)), "ts"))
    assert result(kept) == brute([r for r in rows if r[3] <= cut]) and kept.watermark() == max(r[3] for r in rows if r[3] <= cut)
    fresh = kept.fresh(spark.read.parquet(source), "ts")
    assert "GreaterThan(ts," in fresh._jdf.queryExecution().toString() and fresh.count() == sum(r[3] > cut for r in rows)
    kept.update(fresh)
    assert result(kept) == brute(rows) and kept.version() == 2
    kept.update(kept.fresh(spark.read.parquet(source), "ts"))
    assert result(kept) == brute(rows) and kept.watermark() == max(r[3] for r in rows)


def test_evidence_that_went_and_late_rows(spark, tmp_path, rows):
    kept = Derivation(spark, f"file://{tmp_path}/kept")
    kept.update(spark.createDataFrame(rows[10:], SCHEMA))
    kept.update(spark.createDataFrame(rows[:10], SCHEMA), spark.createDataFrame(rows[50:90], SCHEMA))
    assert result(kept) == brute(rows[:50] + rows[90:])
    kept.update(spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows[:50] + rows[90:], SCHEMA))
    assert result(kept) == {} and kept.watermark() == max(r[3] for r in rows)


def test_a_broken_update_leaves_the_last_version(spark, tmp_path, rows):
    kept = Derivation(spark, f"file://{tmp_path}/kept")
    kept.update(spark.createDataFrame(rows[:50], SCHEMA))
    spark.createDataFrame(rows[50:], SCHEMA).withColumn("n", F.lit(1).cast("long")).write.parquet(f"{tmp_path}/kept/v2/evidence")  # no mark
    assert kept.version() == 1 and result(kept) == brute(rows[:50])
    kept.update(spark.createDataFrame(rows[50:], SCHEMA))
    assert result(kept) == brute(rows)
