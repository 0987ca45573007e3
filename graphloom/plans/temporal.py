"""Temporal queries: windows, buckets, timelines, life cycles, sprints."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import bind
from graphloom.functions import scalars
from graphloom.operators import relational as rel
from graphloom.session import table

T, S = bind.TOUCHED_SQL, bind.SPRINTS_SQL
START, END = "1996-01-01", "1996-06-30"


def commit_buckets(unit):
    """Distinct commits and file changes by day or week (weeks start on Monday), newest first."""

    def run(spark, sf_dir):
        return (
            bind.touches(spark, sf_dir)
            .groupBy(F.date_trunc(unit, "ts").cast("date").alias("bucket"))
            .agg(F.countDistinct("hash").alias("commit_count"), F.count(F.lit(1)).alias("file_changes"))
            .orderBy(F.desc("bucket"))
        )

    return run


def _buckets_sql(unit):
    return f"""WITH {T}
SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS bucket, count(DISTINCT hash) AS commit_count,
       count(*) AS file_changes FROM touched GROUP BY 1"""


def windowed_subgraph_edges(spark, d):
    """Touches in a window that also lets edges without a time pass, of given types, newest first."""
    rows = bind.touches(spark, d).withColumn("rid", F.col("hash") * 1000000 + F.col("path"))
    rows = rows.withColumn("ts", F.when(F.col("path") % 100 != 7, F.col("ts")))
    keep = rel.between(F.col("ts"), START, END, keep_null=True) & F.col("change_type").isin("A", "M")
    return rows.where(keep).orderBy(F.desc_nulls_last("ts"), F.desc("rid")).limit(1000).select("rid", "hash", "path", "change_type", "ts")


def windowed_subgraph_nodes(spark, d):
    edges = windowed_subgraph_edges(spark, d)
    ends = F.explode(F.array(F.struct(F.lit("commit").alias("label"), F.col("hash").alias("id")), F.struct(F.lit("file").alias("label"), F.col("path").alias("id"))))
    return edges.select(ends.alias("n")).select("n.label", "n.id").distinct()


def windowed_subgraph_counts(spark, d):
    """Totals over the same window as the edges, not only the returned page."""
    rows = bind.touches(spark, d).withColumn("ts", F.when(F.col("path") % 100 != 7, F.col("ts")))
    keep = rel.between(F.col("ts"), START, END, keep_null=True) & F.col("change_type").isin("A", "M")
    return rows.where(keep).agg(F.count(F.lit(1)).alias("edges"), (F.countDistinct("hash") + F.countDistinct("path")).alias("nodes"))


def subgraph_by_commits(spark, d):
    """Touches between the times of two commits, whichever is the earlier."""
    c = bind.commits(spark, d)
    bounds = c.where(F.col("hash").isin(100, 200)).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return (
        bind.touches(spark, d).join(F.broadcast(bounds), F.col("ts").between(F.col("lo"), F.col("hi")))
        .orderBy("ts", "hash", "path").offset(10).limit(200).select("hash", "path", "ts", "change_type")
    )


def commit_neighbors(spark, d):
    """Next and previous commit of each author by (time, id)."""
    w = Window.partitionBy("author").orderBy("ts", "hash")
    return bind.commits(spark, d).select("hash", "author", F.lag("hash").over(w).alias("prev"), F.lead("hash").over(w).alias("next"))


def commit_timeline(spark, d):
    """Commits of a window with neighbours taken before the window is cut."""
    return commit_neighbors(spark, d).join(bind.commits(spark, d).select("hash", "ts"), "hash").where(rel.between(F.col("ts"), START, END))


def commit_sequence(spark, d):
    """For each author's middle commit, up to five commits either way in order."""
    w = Window.partitionBy("author").orderBy("ts", "hash")
    ranked = bind.commits(spark, d).select("author", "hash", "ts", F.row_number().over(w).alias("k"))
    middle = ranked.groupBy("author").agg(F.floor((F.max("k") + 1) / 2).cast("long").alias("mid"))
    return ranked.join(middle, "author").where(F.abs(F.col("k") - F.col("mid")) <= 5).select("author", "hash", (F.col("k") - F.col("mid")).cast("long").alias("step"))


def evolution_timeline(spark, d):
    """Commits of a window with their first five files in order and the number of all."""
    c = bind.commits(spark, d).where(rel.between(F.col("ts"), START, END)).select("hash", "ts")
    action = F.when(F.col("change_type") == "A", "created").when(F.col("change_type") == "D", "deleted").otherwise("modified")
    files = bind.touches(spark, d).select("hash", "path", action.alias("action"))
    per = c.join(files, "hash").groupBy("hash", "ts").agg(F.sort_array(F.collect_list(F.struct("path", "action"))).alias("files"))
    shown = F.concat_ws(";", F.transform(F.slice("files", 1, 5), lambda f: F.concat_ws(":", f["path"].cast("string"), f["action"])))
    return per.select("hash", "ts", shown.alias("shown"), F.size("files").cast("long").alias("n_files"))


def file_lifecycle(spark, d):
    t = bind.touches(spark, d)
    return t.groupBy("path").agg(
        F.min("ts").alias("created_at"), F.max(F.when(F.col("change_type") == "D", F.col("ts"))).alias("deleted_at"),
        F.count_if(F.col("change_type") == "M").alias("modifications"),
        F.min_by("change_type", F.struct("ts", "hash")).alias("first_action"), F.max_by("change_type", F.struct("ts", "hash")).alias("last_action"),
    ).join(bind.files(spark, d).select("path", scalars.file_class(scalars.file_name(F.col("name"), F.col("path"))).alias("type")), "path")


def requirement_evolution(spark, d):
    """Two kinds of events of a requirement (first implementation of a file, later touches) in order."""
    rows = table(spark, d, "lineitem").where("l_suppkey = 7").select(F.col("l_suppkey").alias("req"), F.col("l_partkey").alias("path"), F.col("l_shipdate").alias("ts"))
    first = rows.groupBy("req", "path").agg(F.min("ts").alias("ts")).select(F.lit("IMPLEMENTS").alias("kind"), "path", "ts")
    later = rows.join(first.select("path", F.col("ts").alias("f")), "path").where("ts > f").select(F.lit("EVOLVES").alias("kind"), "path", "ts")
    return first.unionByName(later).orderBy("ts", "path", "kind").limit(100)


def file_evolution(spark, d):
    t = bind.touches(spark, d).where(F.col("path").isin(5, 6, 7)).select(F.lit("TOUCHED").alias("kind"), "path", "ts")
    i = table(spark, d, "lineitem").where(F.col("l_partkey").isin(5, 6, 7)).select(F.lit("IMPLEMENTS").alias("kind"), F.col("l_partkey").alias("path"), F.col("l_shipdate").alias("ts"))
    return t.unionByName(i).orderBy("ts", "path", "kind").limit(200)


def activity_rates(spark, d):
    c = bind.commits(spark, d).where(rel.between(F.col("ts"), START, END))
    days = F.greatest(F.lit(1), F.datediff(F.lit(END), F.lit(START)))
    return c.agg((F.count(F.lit(1)) / days).alias("r"), (F.countDistinct("author") / days).alias("a")).select(F.round("r", 6).alias("commits_per_day"), F.round("a", 6).alias("authors_per_day"))


def _daily(spark, d):
    return bind.touches(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("hash").alias("commits"), F.countDistinct("path").alias("files"))


def temporal_metrics(spark, d):
    """Means a day, the share of modifications, and the trend of the second half against the first."""
    day = _daily(spark, d)
    span = day.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.expr("date_add(lo, CAST(datediff(hi, lo) DIV 2 AS INT))").alias("mid"))
    m = day.join(F.broadcast(span)).agg(
        F.round(F.avg("commits"), 6).alias("commits_per_day"), F.round(F.avg("files"), 6).alias("files_per_day"),
        F.sum(F.when(F.col("day") > F.col("mid"), F.col("commits"))).alias("late"), F.sum(F.when(F.col("day") <= F.col("mid"), F.col("commits"))).alias("early"),
    )
    trend = F.when(F.col("late") > 1.1 * F.col("early"), "increasing").when(F.col("late") < 0.9 * F.col("early"), "decreasing").otherwise("stable")
    return m.select("commits_per_day", "files_per_day", trend.alias("trend"))


def peak_day(spark, d):
    return _daily(spark, d).orderBy(F.desc("commits"), "day").limit(1)


def timeline_window_files(spark, d):
    """The last 40 commits up to a time: their files of some folders, by how often they are touched."""
    last = bind.commits(spark, d).where(F.col("ts") <= F.lit("1999-06-30").cast("timestamp")).orderBy(F.desc("ts"), F.desc("hash")).limit(40)
    return (
        bind.touches(spark, d).drop("ts").join(last, "hash").join(bind.files(spark, d), "path").where(F.col("dir").rlike("^Brand#[1-9]$"))
        .groupBy("path", "dir").agg(F.count(F.lit(1)).alias("touches"))
    )


def sprint_list(spark, d):
    n = F.split("number", "-")
    return bind.sprints(spark, d).orderBy(F.desc(n[0].cast("int")), F.desc(n[1].cast("int"))).select("number", "start", "end").limit(12)


def sprint_commits(spark, d):
    rows = rel.in_windows(bind.commits(spark, d), "ts", bind.sprints(spark, d), "start", "end")
    return rows.groupBy("number").agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("authors"))


def sprint_windows(spark, d):
    """For each sprint: newest and oldest commit, their number, and the window they imply (a day either side)."""
    rows = rel.in_windows(bind.commits(spark, d), "ts", bind.sprints(spark, d), "start", "end")
    key = F.struct("ts", "hash")
    return rows.groupBy("number").agg(
        F.max_by("hash", key).alias("newest"), F.min_by("hash", key).alias("oldest"), F.count(F.lit(1)).alias("n"),
        F.date_sub(F.to_date(F.min("ts")), 1).alias("from_day"), F.date_add(F.to_date(F.max("ts")), 1).alias("to_day"),
    )


def sprint_fill_end(spark, d):
    """Missing ends: the day before the next start, or thirteen days after the start."""
    s = bind.sprints(spark, d).withColumn("end", F.when(F.quarter("start") % 2 == 0, F.col("end")))
    after = F.lead("start").over(Window.orderBy("start"))
    return s.select("number", F.coalesce("end", F.date_sub(after, 1), F.date_add("start", 13)).alias("end"))


def sprint_docs(spark, d):
    """Documents of a sprint's folder: the folder is cut off the path, so the prefix join is an equi-join."""
    s = bind.sprints(spark, d).select("number", F.concat(F.lit("docs/sprint-"), "number", F.lit("/")).alias("folder"))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("docs/sprint-"), 1995 + F.col("doc_id") % 7, F.lit("-"), 1 + F.col("doc_id") % 4, F.lit("/"), "doc_id", F.lit(".md")).alias("path"))
    docs = docs.withColumn("folder", F.regexp_extract("path", "^(.*/)[^/]*$", 1))
    return docs.join(s, "folder").select("number", "doc_id")


def sprint_map(spark, d):
    """Sprint to commits to files: distinct counts along the path."""
    rows = rel.in_windows(bind.commits(spark, d), "ts", bind.sprints(spark, d), "start", "end").select("number", "hash")
    return rows.join(bind.touches(spark, d), "hash").groupBy("number").agg(F.countDistinct("hash").alias("commits"), F.countDistinct("path").alias("files"))


def sprint_subgraph(spark, d):
    """Sprint, documents, and the requirements that the documents' numbers point to."""
    docs = sprint_docs(spark, d)
    i = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("req")).distinct()
    return docs.join(i, "doc_id").groupBy("number").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("req").alias("requirements"))


_SUB = f"""{T}, r AS (SELECT hash * 1000000 + path AS rid, hash, path, change_type, CASE WHEN path % 100 <> 7 THEN ts END AS ts FROM touched),
e AS (SELECT * FROM r WHERE (ts IS NULL OR ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}') AND change_type IN ('A', 'M'))"""
_NB = "nb AS (SELECT o_orderkey AS hash, o_custkey AS author, o_orderdate AS ts, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
_DAILY = f"{T}, daily AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT hash) AS commits, count(DISTINCT path) AS files FROM touched GROUP BY 1)"
_SC = f'{S}, sc AS (SELECT number, o_orderkey AS hash, o_custkey AS author, o_orderdate AS ts FROM orders JOIN sprints ON CAST(o_orderdate AS DATE) BETWEEN "start" AND "end")'
_SD = f"{S}, sd AS (SELECT number, doc_id FROM documents JOIN sprints ON number = (1995 + doc_id % 7) || '-' || (1 + doc_id % 4))"

QUERIES = {
    "commit_buckets_week": (commit_buckets("week"), _buckets_sql("week")),
    "commit_buckets_day": (commit_buckets("day"), _buckets_sql("day")),
    "windowed_subgraph_edges": (windowed_subgraph_edges, f"WITH {_SUB} SELECT rid, hash, path, change_type, ts FROM e ORDER BY ts DESC NULLS LAST, rid DESC LIMIT 1000"),
    "windowed_subgraph_nodes": (windowed_subgraph_nodes, f"WITH {_SUB}, p AS (SELECT * FROM e ORDER BY ts DESC NULLS LAST, rid DESC LIMIT 1000) SELECT 'commit' AS label, hash AS id FROM p UNION SELECT 'file', path FROM p"),
    "windowed_subgraph_counts": (windowed_subgraph_counts, f"WITH {_SUB} SELECT count(*) AS edges, count(DISTINCT hash) + count(DISTINCT path) AS nodes FROM e"),
    "subgraph_by_commits": (subgraph_by_commits, f"WITH {T}, b AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders WHERE o_orderkey IN (100, 200)) SELECT hash, path, ts, change_type FROM touched, b WHERE ts BETWEEN lo AND hi ORDER BY ts, hash, path LIMIT 200 OFFSET 10"),
    "commit_neighbors": (commit_neighbors, f"WITH {_NB} SELECT hash, author, prev, next FROM nb"),
    "commit_timeline": (commit_timeline, f"WITH {_NB} SELECT hash, author, prev, next, ts FROM nb WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"),
    "commit_sequence": (commit_sequence, "WITH r AS (SELECT o_custkey AS author, o_orderkey AS hash, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT author, hash, k - (n + 1) // 2 AS step FROM r WHERE abs(k - (n + 1) // 2) <= 5"),
    "evolution_timeline": (evolution_timeline, f"""WITH {T}, x AS (SELECT hash, path, CASE change_type WHEN 'A' THEN 'created' WHEN 'D' THEN 'deleted' ELSE 'modified' END AS a, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM touched)
SELECT o_orderkey AS hash, o_orderdate AS ts, string_agg(CASE WHEN k <= 5 THEN path || ':' || a END, ';' ORDER BY k) AS shown, count(*) AS n_files FROM orders JOIN x ON x.hash = o_orderkey WHERE o_orderdate BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY 1, 2"""),
    "file_lifecycle": (file_lifecycle, f"""WITH {T}, k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, hash) AS f, row_number() OVER (PARTITION BY path ORDER BY ts DESC, hash DESC) AS l FROM touched)
SELECT path, min(ts) AS created_at, max(CASE WHEN change_type = 'D' THEN ts END) AS deleted_at, count(*) FILTER (change_type = 'M') AS modifications, max(CASE WHEN f = 1 THEN change_type END) AS first_action, max(CASE WHEN l = 1 THEN change_type END) AS last_action,
  CASE path % 8 WHEN 0 THEN 'code' WHEN 1 THEN 'code' WHEN 2 THEN 'document' WHEN 3 THEN 'config' WHEN 4 THEN 'code' WHEN 5 THEN 'document' ELSE 'other' END AS type FROM k GROUP BY path"""),
    "requirement_evolution": (requirement_evolution, "WITH r AS (SELECT l_partkey AS path, l_shipdate AS ts FROM lineitem WHERE l_suppkey = 7), f AS (SELECT path, min(ts) AS ts FROM r GROUP BY 1) SELECT * FROM (SELECT 'IMPLEMENTS' AS kind, path, ts FROM f UNION ALL SELECT 'EVOLVES', r.path, r.ts FROM r JOIN f ON f.path = r.path AND r.ts > f.ts) ORDER BY ts, path, kind LIMIT 100"),
    "file_evolution": (file_evolution, f"WITH {T} SELECT * FROM (SELECT 'TOUCHED' AS kind, path, ts FROM touched WHERE path IN (5, 6, 7) UNION ALL SELECT 'IMPLEMENTS', l_partkey, l_shipdate FROM lineitem WHERE l_partkey IN (5, 6, 7)) ORDER BY ts, path, kind LIMIT 200"),
    "activity_rates": (activity_rates, f"SELECT round(count(*) / 181.0::DOUBLE, 6) AS commits_per_day, round(count(DISTINCT o_custkey) / 181.0::DOUBLE, 6) AS authors_per_day FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"),
    "temporal_metrics": (temporal_metrics, f"""WITH {_DAILY}, b AS (SELECT min(day) AS lo, max(day) AS hi FROM daily), m AS (SELECT lo + CAST((hi - lo) // 2 AS INTEGER) AS mid FROM b),
x AS (SELECT round(avg(commits), 6) AS commits_per_day, round(avg(files), 6) AS files_per_day, sum(CASE WHEN day > mid THEN commits END) AS late, sum(CASE WHEN day <= mid THEN commits END) AS early FROM daily, m)
SELECT commits_per_day, files_per_day, CASE WHEN late > 1.1 * early THEN 'increasing' WHEN late < 0.9 * early THEN 'decreasing' ELSE 'stable' END AS trend FROM x"""),
    "peak_day": (peak_day, f"WITH {_DAILY} SELECT * FROM daily ORDER BY commits DESC, day LIMIT 1"),
    "timeline_window_files": (timeline_window_files, f"WITH {T}, l AS (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40) SELECT path, p_brand AS dir, count(*) AS touches FROM touched JOIN l ON l.o_orderkey = hash JOIN part ON p_partkey = path WHERE regexp_matches(p_brand, '^Brand#[1-9]$') GROUP BY 1, 2"),
    "sprint_list": (sprint_list, f'WITH {S} SELECT number, "start", "end" FROM sprints ORDER BY "start" DESC LIMIT 12'),
    "sprint_commits": (sprint_commits, f"WITH {_SC} SELECT number, count(*) AS commits, count(DISTINCT author) AS authors FROM sc GROUP BY 1"),
    "sprint_windows": (sprint_windows, f"WITH {_SC}, k AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY ts, hash) AS a, row_number() OVER (PARTITION BY number ORDER BY ts DESC, hash DESC) AS z FROM sc) SELECT number, max(CASE WHEN z = 1 THEN hash END) AS newest, max(CASE WHEN a = 1 THEN hash END) AS oldest, count(*) AS n, CAST(min(ts) AS DATE) - 1 AS from_day, CAST(max(ts) AS DATE) + 1 AS to_day FROM k GROUP BY 1"),
    "sprint_fill_end": (sprint_fill_end, f'WITH {S}, g AS (SELECT number, "start", CASE WHEN quarter("start") % 2 = 0 THEN "end" END AS e, lead("start") OVER (ORDER BY "start") AS n FROM sprints) SELECT number, coalesce(e, n - 1, "start" + 13) AS "end" FROM g'),
    "sprint_docs": (sprint_docs, f"WITH {_SD} SELECT * FROM sd"),
    "sprint_map": (sprint_map, f"WITH {T}, {_SC} SELECT number, count(DISTINCT sc.hash) AS commits, count(DISTINCT path) AS files FROM sc JOIN touched t ON t.hash = sc.hash GROUP BY 1"),
    "sprint_subgraph": (sprint_subgraph, f"WITH {_SD} SELECT number, count(DISTINCT doc_id) AS docs, count(DISTINCT l_suppkey) AS requirements FROM sd JOIN lineitem ON l_partkey = doc_id GROUP BY 1"),
}
