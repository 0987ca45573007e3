from pyspark.sql import functions as F

from graphloom.functions import scratch


def test_cut_reads_back_the_same_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "i int, s string, v array<double>")
    back = scratch.cut(df)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    assert scratch.scratch_dir(spark) in back.inputFiles()[0]


def test_join_checked_gives_the_same_rows_either_way(spark):
    big, small = spark.range(100).withColumn("v", F.col("id") % 7), spark.range(0, 100, 3)
    ways = [scratch.join_checked(big, small, "id", how, most).count() for how in ("inner", "left_anti", "left") for most in (10, 1000)]
    assert ways == [34, 34, 66, 66, 100, 100]


def test_discard_keeps_the_last_table(spark):
    since = scratch.mark()
    kept = [scratch.cut(spark.range(n)) for n in (1, 2, 3)]
    paths = [df.inputFiles()[0] for df in kept]
    scratch.discard(spark, since)
    assert kept[2].count() == 3 and scratch.mark() == since + 1
    assert [scratch.exists(spark, p) for p in paths] == [False, False, True]
    assert scratch.fingerprint(spark, paths[2]) == scratch.fingerprint(spark, paths[2])


def test_sweep_deletes_the_tables(spark, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_dir", lambda s: f"{scratch.shared_dir(s)}/graphloom/sweep-test")
    back = scratch.cut(spark.range(3))
    assert back.count() == 3 and scratch.sweep(spark)
    assert spark._jvm.java.io.File(scratch.shared_dir(spark).removeprefix("file://") + "/graphloom/sweep-test").exists() is False
