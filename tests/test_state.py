"""Stateful streams: state that ends, and restarts from the checkpoint."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from graphloom.streaming import events as st

SCHEMA = "event_id long, user_id long, ts timestamp"
START = datetime(2024, 1, 1)


def brute(rows, gap):
    last, out = {}, {}
    for event, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        out[event] = user not in last or (ts - last[user]).total_seconds() >= gap
        if out[event]:
            last[user] = ts
    return out


def day(n):
    """Thirty users of their own each day, three events each; and one who comes every day."""
    rows = [(n * 1000 + 10 * u + k, n * 100 + u, START + timedelta(days=n, minutes=7 * u + 20 * k)) for u in range(30) for k in range(3)]
    return rows + [(n * 1000 + 999, 0, START + timedelta(days=n, hours=5))]


def test_state_ends_and_a_restart_goes_on(spark, tmp_path):
    days, gap = 6, 1800
    held, rows = [], []
    for n in range(days):
        rows += day(n)
        spark.createDataFrame(day(n), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        # Each day is a run of its own that starts from the checkpoint of the one before.
        query = st.debounce(stream, gap, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r.event_id: r.accepted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == brute(rows, gap)
    users = len({r[1] for r in rows})
    assert max(held) <= 2 * 31 < users, held


def test_late_events_within_the_delay_count(spark, tmp_path):
    rows = [(1, 1, START), (2, 1, START + timedelta(minutes=50)), (3, 2, START + timedelta(minutes=10))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = st.drain(st.debounce(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 3600, "2 hours"), "late")
    assert {r.event_id: r.accepted for r in out.where(F.col("user_id") > 0).collect()} == {1: True, 2: False, 3: True}
