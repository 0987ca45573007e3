"""Streaming queries, each run over all events and held against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import table
from graphloom.sources.sinks import byte_batches
from graphloom.streaming import events as st

DELAY, GAP = "10 minutes", 6 * 3600


def _events(spark, d):
    return st.stream_of(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df):
    return df.select("start", "end", "event_type", "n", F.round("v", 4).alias("v"))


def events_tumbling(spark, d):
    return _plain(st.drain(st.windowed_counts(_events(spark, d), DELAY, "6 hours"), "tumbling"))


def events_sliding(spark, d):
    return _plain(st.drain(st.windowed_counts(_events(spark, d), DELAY, "1 hour", "30 minutes"), "sliding"))


def events_session(spark, d):
    return st.drain(st.sessions(_events(spark, d), DELAY, "3 hours"), "session")


def debounce(spark, d):
    out = st.drain(st.debounce(st.stream_of(spark, d), GAP), "debounce")
    return out.where("accepted").select("event_id", "user_id")


def ttl_cache_hits(spark, d):
    out = st.drain(st.debounce(st.stream_of(spark, d), GAP), "ttl")
    return out.groupBy("user_id").agg(F.count_if(~F.col("accepted")).alias("hits"), F.count(F.lit(1)).alias("requests"))


def cache_hits(spark, d):
    cache = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    out = st.drain(st.cache_hits(st.stream_of(spark, d).select("event_id", "user_id"), cache, "user_id"), "cache")
    return out.groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


def rolling_latency(spark, d):
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(-99, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w) + 1e-9, 4).alias("rolling"))


def batch_by_bytes(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("grp"), "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return byte_batches(rows, "doc_id", "bytes", 20_000).groupBy("grp", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def event_payload(spark, d):
    """A value of the JSON payload, by type."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


_MARK = "mk AS (SELECT max(ts) - INTERVAL 10 MINUTES AS mark FROM events)"
QUERIES = {
    "events_tumbling": (events_tumbling, f"""WITH {_MARK}, w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS "start", event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)
SELECT "start", "start" + INTERVAL 6 HOURS AS "end", event_type, n, v FROM w, mk WHERE "start" + INTERVAL 6 HOURS <= mark"""),
    "events_sliding": (events_sliding, f"""WITH {_MARK}, x AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS "start", event_type, value FROM events, (VALUES (0), (1)) v(k)),
w AS (SELECT "start", event_type, count(*) AS n, round(sum(value), 4) AS v FROM x GROUP BY 1, 2) SELECT "start", "start" + INTERVAL 1 HOUR AS "end", event_type, n, v FROM w, mk WHERE "start" + INTERVAL 1 HOUR <= mark"""),
    "events_session": (events_session, f"""WITH {_MARK}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
w AS (SELECT min(ts) AS "start", max(ts) + INTERVAL 3 HOURS AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k) SELECT w.* FROM w, mk WHERE "end" <= mark"""),
    "debounce": (debounce, """WITH RECURSIVE r AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
UNION ALL SELECT r.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 6 HOURS) FROM r WHERE r.ts IS NOT NULL)
SELECT min(event_id) AS event_id, r.user_id FROM r JOIN events e ON e.user_id = r.user_id AND e.ts = r.ts GROUP BY r.user_id, r.ts"""),
    "ttl_cache_hits": (ttl_cache_hits, """WITH RECURSIVE r AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
UNION ALL SELECT r.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 6 HOURS) FROM r WHERE r.ts IS NOT NULL),
a AS (SELECT user_id, count(ts) AS n FROM r GROUP BY 1) SELECT e.user_id, count(*) - any_value(a.n) AS hits, count(*) AS requests FROM events e JOIN a ON a.user_id = e.user_id GROUP BY 1"""),
    "cache_hits": (cache_hits, "SELECT user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS hit, count(*) AS n FROM events GROUP BY 1"),
    "rolling_latency": (rolling_latency, "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS 99 PRECEDING) + 1e-9::DOUBLE, 4) AS rolling FROM events"),
    "batch_by_bytes": (batch_by_bytes, "WITH b AS (SELECT source AS grp, strlen(text) AS bytes, (CAST(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) - 1) // 20000 AS batch FROM documents) SELECT grp, batch, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM b GROUP BY 1, 2"),
    "event_payload": (event_payload, "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS INT)) AS k_max FROM events GROUP BY 1"),
}
