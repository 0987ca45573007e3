"""The map of a photo is made once a row, in as many tasks as the rows need."""

from graphloom.plans import extra

SF = "/root/testdata/sf0.001"


def test_the_map_stands_in_the_plan_once(spark):
    plan = extra.photo_properties(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map(FNumber") == 1


def test_small_files_are_spread(spark, monkeypatch):
    monkeypatch.setattr(extra, "PHOTOS", 20)
    rows = extra.photo_properties(spark, SF)
    assert rows.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/part.parquet").count() // 20)
