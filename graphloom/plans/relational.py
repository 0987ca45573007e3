"""Filters, joins, aggregates, paging and set operations over the artifact graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import bind
from graphloom.functions import scalars
from graphloom.operators import relational as rel
from graphloom.session import table

T = bind.TOUCHED_SQL


def nodes_by_type(spark, d):
    return bind.files(spark, d).where(F.col("language") == "ECONOMY").select("path", "dir", "loc")


def relations_by_type(spark, d):
    return bind.touches(spark, d).where(F.col("change_type") == "M").select("hash", "path", "ts")


def search_any_property(spark, d):
    return table(spark, d, "customer").where(rel.any_contains(["c_custkey", "c_name", "c_mktsegment"], "BUILD")).select("c_custkey", "c_name")


def like_chain(spark, d):
    """CONTAINS, prefix, suffix, regex, IN and NOT IN in one predicate."""
    name = F.col("p_name")
    test = (name.contains("o") & (name.startswith("s") | name.endswith("t"))) | name.rlike("^(red|blue) ")
    return table(spark, d, "part").where(test & F.col("p_size").isin(*range(1, 31)) & ~F.col("p_brand").isin("Brand#1", "Brand#2")).select("p_partkey", "p_name")


def _paths(spark, d):
    return bind.files(spark, d).select("path", scalars.file_name(F.col("name"), F.col("path")).alias("file"))


_PATHS_SQL = """paths AS (SELECT p_partkey AS path, replace(p_name, ' ', '_') || '_' || p_partkey ||
  CASE p_partkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.json' WHEN 2 THEN '.md' WHEN 3 THEN '.yaml' WHEN 4 THEN '.tsx' WHEN 5 THEN '.txt' WHEN 6 THEN '.css' ELSE '' END AS file FROM part)"""


def classify_files(spark, d):
    return _paths(spark, d).select("path", scalars.file_class(F.col("file")).alias("type"))


def categorize_files(spark, d):
    return _paths(spark, d).groupBy(scalars.file_category(F.col("file")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def payload_filtered(spark, d):
    spec = {"p_type": ["ECONOMY", "SMALL"], "p_size": {"gte": 10, "lte": 20}}
    return table(spark, d, "part").where(rel.payload_filter(spec)).select("p_partkey", "p_type", "p_size")


def must_should(spark, d):
    must = F.col("p_size") <= 25
    should = (F.col("p_brand") == "Brand#4") | (F.col("p_type") == "STANDARD")
    return table(spark, d, "part").where(must & should).select("p_partkey")


def projections(spark, d):
    """Slices, comprehensions with a filter, and heads of each commit's sorted lines."""
    lines = F.sort_array(F.collect_list(F.struct("line", "path", "change_type")))
    rows = bind.raw_touches(spark, d).groupBy("hash").agg(lines.alias("lines"))
    return rows.select(
        "hash",
        F.concat_ws(",", F.transform(F.slice("lines", 1, 2), lambda x: x["path"].cast("string"))).alias("first_two"),
        F.size(F.filter("lines", lambda x: x["change_type"] == "D")).cast("long").alias("deleted"),
        F.element_at("lines", 1)["change_type"].alias("head_type"),
    )


def node_identity(spark, d):
    """The first identity that is there, and the number of properties that are not null."""
    rows = table(spark, d, "orders").select(
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("uid"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("hash"),
        F.col("o_orderkey").alias("key"),
    )
    props = F.map_filter(F.create_map(F.lit("uid"), "uid", F.lit("hash"), "hash"), lambda k, v: v.isNotNull())
    return rows.select(
        "key", F.coalesce("uid", "hash", F.md5(F.col("key").cast("string"))).alias("identity"), F.size(props).cast("long").alias("n_props")
    )


def commit_files(spark, d):
    return (
        bind.commits(spark, d).join(bind.touches(spark, d).drop("ts"), "hash")
        .join(bind.files(spark, d), "path").select("hash", "author", "path", "dir", "change_type")
    )


def commit_details(spark, d):
    sums = bind.touches(spark, d).groupBy("hash").agg(
        F.sum(F.when(F.col("change_type") != "D", F.col("additions")).otherwise(0.0)).alias("lines_added"),
        F.sum(F.when(F.col("change_type") == "D", F.col("additions")).otherwise(0.0)).alias("lines_deleted"),
        F.count(F.lit(1)).alias("files"),
    )
    return bind.commits(spark, d).join(sums, "hash").select("hash", "author", "ts", "message", "lines_added", "lines_deleted", "files")


def _implements(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("req"), F.col("l_partkey").alias("path"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("kind"),
    )


WINDOW = ("1996-01-01", "1996-06-30")


def traceability(spark, d):
    """Coverage of requirements in a window; the window stands in the join condition, so requirements
    without files in it stay with 0."""
    per = (
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
        .join(_implements(spark, d), (F.col("id") == F.col("req")) & rel.between(F.col("ts"), *WINDOW), "left")
        .groupBy("id").agg(F.count("path").alias("files"))
    )
    return per.agg(
        F.count_if(F.col("files") > 0).alias("implemented"), F.count_if(F.col("files") == 0).alias("unimplemented"),
        F.round(F.avg("files"), 6).alias("avg_files"), F.round(100 * F.count_if(F.col("files") > 0) / F.count(F.lit(1)), 6).alias("coverage"),
    )


def traceability_optional_match(spark, d):
    """The variant that counts the empty match as one."""
    per = (
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
        .join(_implements(spark, d), (F.col("id") == F.col("req")) & rel.between(F.col("ts"), *WINDOW), "left")
        .groupBy("id").agg(F.count(F.lit(1)).alias("files"))
    )
    return per.agg(F.round(F.avg("files"), 6).alias("avg_files"))


def audit_checks(spark, d):
    """Six anti-join checks, one row each."""
    commits, touched, files = bind.commits(spark, d), bind.touches(spark, d), bind.files(spark, d)
    authors = table(spark, d, "customer").select(F.col("c_custkey").alias("author"))
    reqs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("req"))
    docs = table(spark, d, "documents").select("doc_id")
    checks = {
        "commits_without_files": commits.join(touched, "hash", "left_anti"),
        "files_without_commits": files.join(touched, "path", "left_anti"),
        "authors_without_commits": authors.join(commits, "author", "left_anti"),
        "touches_without_file": touched.join(files, "path", "left_anti"),
        "requirements_without_files": reqs.join(_implements(spark, d), "req", "left_anti"),
        "documents_without_labels": docs.join(table(spark, d, "labels"), "doc_id", "left_anti"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def orphans(spark, d):
    """Files and commits on neither end of any touch."""
    t = bind.touches(spark, d)
    ends = t.select(F.concat(F.lit("c"), "hash").alias("id")).unionAll(t.select(F.concat(F.lit("f"), "path").alias("id")))
    nodes = bind.commits(spark, d).select(F.concat(F.lit("c"), "hash").alias("id"), F.lit("commit").alias("label")).unionAll(
        bind.files(spark, d).select(F.concat(F.lit("f"), "path"), F.lit("file"))
    )
    return nodes.join(ends, "id", "left_anti")


def lookup_by_ids(spark, d):
    wanted = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", "lang", "source")


def activity(spark, d):
    c = bind.commits(spark, d).where(rel.between(F.col("ts"), *WINDOW))
    t = bind.touches(spark, d).select("hash", "path")
    return c.join(t, "hash", "left").agg(
        F.countDistinct("hash").alias("commits"), F.countDistinct("author").alias("authors"), F.count("path").alias("changes")
    )


def chunk_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("n_chars") > 2000).alias("long"), F.round(F.avg("n_chars"), 6).alias("avg_length"),
        F.count_if(F.col("text").contains("\n")).alias("multi_line"),
    )


def confidence_stats(spark, d):
    w = F.element_at(F.create_map(F.lit("A"), F.lit(0.8), F.lit("N"), F.lit(0.6), F.lit("R"), F.lit(0.4)), F.col("kind"))
    return _implements(spark, d).select(w.alias("c")).agg(
        F.round(F.avg("c"), 3).alias("avg_confidence"), F.count_if(F.col("c") >= 0.8).alias("high"),
        F.count_if((F.col("c") >= 0.5) & (F.col("c") < 0.8)).alias("medium"), F.count_if(F.col("c") < 0.5).alias("low"),
    )


def node_counts(spark, d):
    """Nodes by label, a node counting under each of its labels."""
    rows = table(spark, d, "part").select(F.explode(F.array(F.lit("File"), F.initcap("p_type"))).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def edge_counts(spark, d):
    return bind.touches(spark, d).groupBy("change_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


def sprint_file_rollup(spark, d):
    s = bind.sprints(spark, d)
    return (
        rel.in_windows(bind.touches(spark, d), "ts", s, "start", "end")
        .groupBy("number", "path").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    )


def duplicate_edges(spark, d):
    return bind.raw_touches(spark, d).groupBy("hash", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sprint_requirements(spark, d):
    s = bind.sprints(spark, d)
    rows = rel.in_windows(_implements(spark, d), "ts", s, "start", "end")
    return rows.groupBy("number").agg(F.size(F.collect_set("req")).cast("long").alias("requirements"))


def best_score(spark, d):
    """One mention for each (document source, language): the longest text."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.max("n_chars").alias("score"))


def library_usage_top(spark, d):
    return (
        bind.files(spark, d).groupBy(F.col("dir").alias("library")).agg(F.countDistinct("language").alias("languages"), F.count(F.lit(1)).alias("files"))
        .orderBy(F.desc("files"), "library").limit(20)
    )


def graph_summary(spark, d):
    return bind.touches(spark, d).agg(
        F.count_if(F.col("change_type") == "A").alias("created"), F.count_if(F.col("change_type") == "M").alias("modified"),
        F.count_if(F.col("change_type") == "D").alias("deleted"), F.countDistinct("hash").alias("commits"), F.countDistinct("path").alias("files"),
    )


def _one(df, name):
    return df.agg(F.count(F.lit(1)).alias(name))


def stats(spark, d):
    """Independent sub-aggregates side by side (one-row frames); the window ends at the newest touch."""
    t = bind.touches(spark, d)
    last = t.agg(F.max("ts").alias("now"))
    recent = t.join(F.broadcast(last)).agg(
        F.count_if(F.col("ts") >= F.col("now") - F.expr("INTERVAL 30 DAYS")).alias("touches_30d"),
        F.countDistinct(F.when(F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS"), F.col("hash"))).alias("commits_7d"),
    )
    return _one(bind.commits(spark, d), "commits").join(_one(bind.files(spark, d), "files")).join(_one(t, "touches")).join(recent)


def churn_by_path(spark, d):
    """Additions and deletions by path; rename braces collapse to the new name, binary rows are left out."""
    rows = bind.raw_touches(spark, d).select(
        scalars.rename_target(F.concat(F.lit("src/{old => "), F.col("path") % 50, F.lit("}/f"))).alias("path"),
        F.when(F.col("line") == 7, F.lit("-")).otherwise(F.col("additions").cast("string")).alias("added"),
    )
    return rows.where("added <> '-'").groupBy("path").agg(F.round(F.sum(F.col("added").cast("double")), 6).alias("additions"), F.count(F.lit(1)).alias("changes"))


def churn_by_lang(spark, d):
    return bind.touches(spark, d).join(bind.files(spark, d), "path").groupBy("language").agg(F.round(F.sum("additions"), 6).alias("additions"))


def collection_info(spark, d):
    e = table(spark, d, "embeddings")
    return e.agg(
        F.count(F.lit(1)).alias("points"), F.min(F.size("embedding")).cast("long").alias("size"), F.countDistinct("label").alias("labels"),
        F.count("embedding").alias("vectors"),
    )


def collection_sample(spark, d):
    return table(spark, d, "embeddings").orderBy("vec_id").limit(5).select(
        "vec_id", F.col("embedding").isNotNull().alias("has_vector"), F.col("label").isNotNull().alias("has_payload")
    )


def embedding_coverage(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, d, "documents").join(e, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"),
        F.round(100 * F.count("embedding") / F.count(F.lit(1)), 6).alias("coverage"),
    )


def list_nodes(spark, d):
    return bind.files(spark, d).orderBy("path").offset(100).limit(50).select("path", "dir")


def list_chunks(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").offset(20).limit(30).select("doc_id", "lang", "n_chars")


def list_images(spark, d):
    """The third page of 25 by length, with the exact total on each row."""
    rows = table(spark, d, "documents").where("lang = 'en'")
    page = rows.orderBy(F.desc("n_chars"), "doc_id").offset(50).limit(25).select("doc_id", "n_chars")
    return page.join(rows.agg(F.count(F.lit(1)).alias("total")))


def _rid(spark, d):
    return bind.touches(spark, d).withColumn("rid", F.col("hash") * 1000000 + F.col("path"))


def subgraph_page2(spark, d):
    return rel.keyset_page(_rid(spark, d), "ts", "rid", 500, ("2000-01-01", 0)).select("rid", "ts", "hash", "path")


def timeline_capped(spark, d):
    return rel.capped(bind.touches(spark, d), ["hash"], [F.col("path")], 3).select("hash", "path", "change_type", F.col("rank").cast("long").alias("rank"))


def cochange_rank(spark, d):
    return (
        bind.touches(spark, d).groupBy("path").agg(F.countDistinct("hash").alias("n"), F.max("ts").alias("last_ts"))
        .orderBy(F.desc("n"), F.desc("last_ts"), "path").limit(100)
    )


def lod_nodes(spark, d):
    """The 200 nodes of highest priority by type, then size."""
    priority = F.when(F.col("language") == "ECONOMY", 3).when(F.col("language") == "SMALL", 2).otherwise(1)
    return bind.files(spark, d).withColumn("priority", priority).orderBy(F.desc("priority"), F.desc("loc"), "path").limit(200).select("path", F.col("priority").cast("long").alias("priority"), "loc")


def lod_edges(spark, d):
    priority = F.when(F.col("change_type") == "A", 3).when(F.col("change_type") == "D", 2).otherwise(1)
    return _rid(spark, d).withColumn("priority", priority).orderBy(F.desc("priority"), "rid").limit(300).select("rid", F.col("priority").cast("long").alias("priority"))


def sample_points(spark, d):
    """A repeatable sample in hash order."""
    return table(spark, d, "embeddings").orderBy(F.md5(F.concat(F.lit("seed-42-"), "vec_id")), "vec_id").limit(50).select("vec_id", "label")


def slowest_documents(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(5).select("doc_id", "n_chars")


def sprint_edges(spark, d):
    """Three kinds of edges of a sprint in one table."""
    s = bind.sprints(spark, d).where("number = '1996-2'")
    c = rel.in_windows(bind.commits(spark, d), "ts", s, "start", "end")
    t = bind.touches(spark, d).drop("ts")
    includes = c.select(F.lit("INCLUDES").alias("type"), F.col("number").alias("src"), F.col("hash").cast("string").alias("dst"))
    touched = c.join(t, "hash").select(F.lit("TOUCHED").alias("type"), F.col("hash").cast("string").alias("src"), F.col("path").cast("string").alias("dst"))
    involves = c.join(t, "hash").select(F.lit("INVOLVES_FILE").alias("type"), F.col("number").alias("src"), F.col("path").cast("string").alias("dst")).distinct()
    return includes.unionByName(touched).unionByName(involves)


def first_seen_union(spark, d):
    """Three indexes merged, the first that has an id wins."""
    docs = table(spark, d, "documents")
    parts = [docs.where("lang = 'en'"), docs.where("n_chars > 3000"), docs.where("source = 'src1'")]
    rows = None
    for k, part in enumerate(parts):
        one = part.select("doc_id", F.lit(k).cast("long").alias("found_in"))
        rows = one if rows is None else rows.unionAll(one)
    return rows.groupBy("doc_id").agg(F.min("found_in").alias("found_in"))


def touched_files_union(spark, d):
    t = bind.touches(spark, d)
    return t.where("change_type = 'A'").select("path").union(t.where("change_type = 'M'").select("path")).distinct()


def manifest_diff(spark, d):
    """Two snapshots of files (path, size): added, modified, removed, unchanged."""
    rows = bind.files(spark, d)
    old = rows.where("path % 10 <> 0").select("path", F.col("loc").alias("old"))
    new = rows.where("path % 10 <> 1").select("path", F.when(F.col("path") % 10 == 2, F.col("loc") + 1).otherwise(F.col("loc")).alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return old.join(new, "path", "full_outer").select("path", state.alias("state"))


def decoding_summary(spark, d):
    """Encodings of pages with counts and up to five sample ids each."""
    declared = F.lower(F.regexp_extract("html", r'charset="?([A-Za-z0-9-]+)', 1))
    rows = table(spark, d, "pages").select("page_id", F.when(declared == "", "none").otherwise(declared).alias("encoding"), F.col("html").contains("�").alias("replaced"))
    ranked = rel.capped(rows, ["encoding"], [F.col("page_id")], 5).groupBy("encoding").agg(F.concat_ws(",", F.sort_array(F.collect_list("page_id")).cast("array<string>")).alias("samples"))
    return rows.groupBy("encoding").agg(F.count(F.lit(1)).alias("pages"), F.count_if("replaced").alias("replaced")).join(ranked, "encoding")


def peer_segments(spark, d):
    """Customers above their nation's mean balance (aggregate joined back)."""
    c = table(spark, d, "customer")
    mean = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"))
    return c.join(mean, "c_nationkey").where("c_acctbal > mean").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


_IMPL = "impl AS (SELECT l_suppkey AS req, l_partkey AS path, l_shipdate AS ts, l_returnflag AS kind FROM lineitem)"
_TRACE = "ON s.s_suppkey = i.req AND i.ts >= TIMESTAMP '1996-01-01' AND i.ts <= TIMESTAMP '1996-06-30'"
_S = bind.SPRINTS_SQL

QUERIES = {
    "nodes_by_type": (nodes_by_type, "SELECT p_partkey AS path, p_brand AS dir, p_size AS loc FROM part WHERE p_type = 'ECONOMY'"),
    "relations_by_type": (relations_by_type, f"WITH {T} SELECT hash, path, ts FROM touched WHERE change_type = 'M'"),
    "search_any_property": (search_any_property, "SELECT c_custkey, c_name FROM customer WHERE contains(CAST(c_custkey AS VARCHAR), 'BUILD') OR contains(c_name, 'BUILD') OR contains(c_mktsegment, 'BUILD')"),
    "like_chain": (like_chain, "SELECT p_partkey, p_name FROM part WHERE ((contains(p_name, 'o') AND (starts_with(p_name, 's') OR ends_with(p_name, 't'))) OR regexp_matches(p_name, '^(red|blue) ')) AND p_size BETWEEN 1 AND 30 AND p_brand NOT IN ('Brand#1', 'Brand#2')"),
    "classify_files": (classify_files, f"WITH {_PATHS_SQL} SELECT path, CASE WHEN contains(file, '.py') OR contains(file, '.js') OR contains(file, '.ts') THEN 'code' WHEN contains(file, '.md') OR contains(file, '.txt') THEN 'document' WHEN contains(file, '.json') OR contains(file, '.yaml') OR contains(file, '.yml') THEN 'config' ELSE 'other' END AS type FROM paths"),
    "categorize_files": (categorize_files, f"WITH {_PATHS_SQL}, e AS (SELECT regexp_extract(lower(file), '(\\.[a-z]+)$', 1) AS ext FROM paths) SELECT CASE WHEN ext IN ('.md', '.txt', '.rst') THEN 'doc' WHEN ext IN ('.py', '.ts', '.tsx', '.js', '.jsx') THEN 'code' ELSE 'other' END AS category, count(*) AS n FROM e GROUP BY 1"),
    "payload_filter": (payload_filtered, "SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size BETWEEN 10 AND 20"),
    "must_should": (must_should, "SELECT p_partkey FROM part WHERE p_size <= 25 AND (p_brand = 'Brand#4' OR p_type = 'STANDARD')"),
    "projections": (projections, """WITH r AS (SELECT l_orderkey AS hash, l_linenumber AS line, l_partkey AS path, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END AS t,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END) AS k FROM lineitem)
SELECT hash, string_agg(CASE WHEN k <= 2 THEN CAST(path AS VARCHAR) END, ',' ORDER BY k) AS first_two, count(*) FILTER (t = 'D') AS deleted, max(CASE WHEN k = 1 THEN t END) AS head_type FROM r GROUP BY hash"""),
    "node_identity": (node_identity, "WITH r AS (SELECT nullif(o_orderstatus, 'P') AS uid, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS hash, o_orderkey AS key FROM orders) SELECT key, coalesce(uid, hash, md5(CAST(key AS VARCHAR))) AS identity, CAST((uid IS NOT NULL)::INT + (hash IS NOT NULL)::INT AS BIGINT) AS n_props FROM r"),
    "commit_files": (commit_files, f"WITH {T} SELECT t.hash, o_custkey AS author, path, p_brand AS dir, change_type FROM touched t JOIN orders ON o_orderkey = t.hash JOIN part ON p_partkey = path"),
    "commit_details": (commit_details, f"WITH {T}, s AS (SELECT hash, sum(CASE WHEN change_type <> 'D' THEN additions ELSE 0 END) AS lines_added, sum(CASE WHEN change_type = 'D' THEN additions ELSE 0 END) AS lines_deleted, count(*) AS files FROM touched GROUP BY 1) SELECT s.hash, o_custkey AS author, o_orderdate AS ts, o_orderpriority || ' ' || o_orderstatus AS message, lines_added, lines_deleted, files FROM s JOIN orders ON o_orderkey = s.hash"),
    "traceability": (traceability, f"WITH {_IMPL}, per AS (SELECT s_suppkey AS id, count(i.path) AS files FROM supplier s LEFT JOIN impl i {_TRACE} GROUP BY 1) SELECT count(*) FILTER (files > 0) AS implemented, count(*) FILTER (files = 0) AS unimplemented, round(avg(files), 6) AS avg_files, round(100.0::DOUBLE * count(*) FILTER (files > 0) / count(*), 6) AS coverage FROM per"),
    "traceability_optional_match": (traceability_optional_match, f"WITH {_IMPL}, per AS (SELECT s_suppkey AS id, count(*) AS files FROM supplier s LEFT JOIN impl i {_TRACE} GROUP BY 1) SELECT round(avg(files), 6) AS avg_files FROM per"),
    "audit_checks": (audit_checks, f"""WITH {T} SELECT 'commits_without_files' AS "check", count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT hash FROM touched)
UNION ALL SELECT 'files_without_commits', count(*) FROM part WHERE p_partkey NOT IN (SELECT path FROM touched)
UNION ALL SELECT 'authors_without_commits', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'touches_without_file', count(*) FROM touched WHERE path NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'requirements_without_files', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)
UNION ALL SELECT 'documents_without_labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""),
    "orphans": (orphans, f"WITH {T} SELECT 'c' || o_orderkey AS id, 'commit' AS label FROM orders WHERE o_orderkey NOT IN (SELECT hash FROM touched) UNION ALL SELECT 'f' || p_partkey, 'file' FROM part WHERE p_partkey NOT IN (SELECT path FROM touched)"),
    "lookup_by_ids": (lookup_by_ids, "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "activity": (activity, f"WITH {T} SELECT count(DISTINCT o_orderkey) AS commits, count(DISTINCT o_custkey) AS authors, count(path) AS changes FROM orders LEFT JOIN touched ON hash = o_orderkey WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'"),
    "chunk_stats": (chunk_stats, "SELECT lang, count(*) AS chunks, count(*) FILTER (n_chars > 2000) AS long, round(avg(n_chars), 6) AS avg_length, count(*) FILTER (contains(text, chr(10))) AS multi_line FROM documents GROUP BY 1"),
    "confidence_stats": (confidence_stats, "WITH c AS (SELECT CAST(CASE l_returnflag WHEN 'A' THEN 0.8 WHEN 'N' THEN 0.6 ELSE 0.4 END AS DOUBLE) AS c FROM lineitem) SELECT round(avg(c), 3) AS avg_confidence, count(*) FILTER (c >= 0.8) AS high, count(*) FILTER (c >= 0.5 AND c < 0.8) AS medium, count(*) FILTER (c < 0.5) AS low FROM c"),
    "node_counts": (node_counts, "SELECT label, count(*) AS n FROM (SELECT unnest(['File', upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))]) AS label FROM part) GROUP BY 1"),
    "edge_counts": (edge_counts, f"WITH {T} SELECT change_type, count(*) AS n FROM touched GROUP BY 1"),
    "sprint_file_rollup": (sprint_file_rollup, f"WITH {T}, {_S} SELECT number, path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM touched JOIN sprints ON CAST(ts AS DATE) BETWEEN \"start\" AND \"end\" GROUP BY 1, 2"),
    "duplicate_edges": (duplicate_edges, "SELECT l_orderkey AS hash, l_partkey AS path, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "sprint_requirements": (sprint_requirements, f"WITH {_IMPL}, {_S} SELECT number, count(DISTINCT req) AS requirements FROM impl JOIN sprints ON CAST(ts AS DATE) BETWEEN \"start\" AND \"end\" GROUP BY 1"),
    "best_score": (best_score, "SELECT source, lang, max(n_chars) AS score FROM documents GROUP BY 1, 2"),
    "library_usage_top": (library_usage_top, "SELECT p_brand AS library, count(DISTINCT p_type) AS languages, count(*) AS files FROM part GROUP BY 1 ORDER BY files DESC, library LIMIT 20"),
    "graph_summary": (graph_summary, f"WITH {T} SELECT count(*) FILTER (change_type = 'A') AS created, count(*) FILTER (change_type = 'M') AS modified, count(*) FILTER (change_type = 'D') AS deleted, count(DISTINCT hash) AS commits, count(DISTINCT path) AS files FROM touched"),
    "stats": (stats, f"WITH {T}, l AS (SELECT max(ts) AS now FROM touched) SELECT (SELECT count(*) FROM orders) AS commits, (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM touched) AS touches, (SELECT count(*) FROM touched, l WHERE ts >= now - INTERVAL 30 DAYS) AS touches_30d, (SELECT count(DISTINCT hash) FROM touched, l WHERE ts >= now - INTERVAL 7 DAYS) AS commits_7d"),
    "churn_by_path": (churn_by_path, "SELECT 'src/' || (l_partkey % 50) || '/f' AS path, round(sum(l_quantity), 6) AS additions, count(*) AS changes FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1"),
    "churn_by_lang": (churn_by_lang, "SELECT p_type AS language, round(sum(l_quantity), 6) AS additions FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "collection_info": (collection_info, "SELECT count(*) AS points, CAST(min(len(embedding)) AS BIGINT) AS size, count(DISTINCT label) AS labels, count(embedding) AS vectors FROM embeddings"),
    "collection_sample": (collection_sample, "SELECT vec_id, embedding IS NOT NULL AS has_vector, label IS NOT NULL AS has_payload FROM embeddings ORDER BY vec_id LIMIT 5"),
    "embedding_coverage": (embedding_coverage, "SELECT count(*) AS chunks, count(vec_id) AS embedded, round(100.0::DOUBLE * count(vec_id) / count(*), 6) AS coverage FROM documents LEFT JOIN embeddings ON vec_id = doc_id"),
    "list_nodes": (list_nodes, "SELECT p_partkey AS path, p_brand AS dir FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100"),
    "list_chunks": (list_chunks, "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 30 OFFSET 20"),
    "list_images": (list_images, "SELECT doc_id, n_chars, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50"),
    "subgraph_page2": (subgraph_page2, f"WITH {T}, r AS (SELECT hash * 1000000 + path AS rid, ts, hash, path FROM touched) SELECT * FROM r WHERE ts < TIMESTAMP '2000-01-01' OR (ts = TIMESTAMP '2000-01-01' AND rid < 0) ORDER BY ts DESC, rid DESC LIMIT 500"),
    "timeline_capped": (timeline_capped, f"WITH {T}, r AS (SELECT hash, path, change_type, row_number() OVER (PARTITION BY hash ORDER BY path) AS rank FROM touched) SELECT * FROM r WHERE rank <= 3"),
    "cochange_rank": (cochange_rank, f"WITH {T} SELECT path, count(DISTINCT hash) AS n, max(ts) AS last_ts FROM touched GROUP BY 1 ORDER BY n DESC, last_ts DESC, path LIMIT 100"),
    "lod_nodes": (lod_nodes, "SELECT p_partkey AS path, CAST(CASE p_type WHEN 'ECONOMY' THEN 3 WHEN 'SMALL' THEN 2 ELSE 1 END AS BIGINT) AS priority, p_size AS loc FROM part ORDER BY priority DESC, loc DESC, path LIMIT 200"),
    "lod_edges": (lod_edges, f"WITH {T} SELECT hash * 1000000 + path AS rid, CAST(CASE change_type WHEN 'A' THEN 3 WHEN 'D' THEN 2 ELSE 1 END AS BIGINT) AS priority FROM touched ORDER BY priority DESC, rid LIMIT 300"),
    "sample_points": (sample_points, "SELECT vec_id, label FROM embeddings ORDER BY md5('seed-42-' || vec_id), vec_id LIMIT 50"),
    "slowest_documents": (slowest_documents, "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5"),
    "sprint_edges": (sprint_edges, f"""WITH {T}, {_S}, c AS (SELECT number, o_orderkey AS hash FROM orders JOIN sprints ON CAST(o_orderdate AS DATE) BETWEEN "start" AND "end" WHERE number = '1996-2')
SELECT 'INCLUDES' AS type, number AS src, CAST(hash AS VARCHAR) AS dst FROM c UNION ALL SELECT 'TOUCHED', CAST(c.hash AS VARCHAR), CAST(path AS VARCHAR) FROM c JOIN touched t ON t.hash = c.hash
UNION ALL SELECT DISTINCT 'INVOLVES_FILE', number, CAST(path AS VARCHAR) FROM c JOIN touched t ON t.hash = c.hash"""),
    "first_seen_union": (first_seen_union, "SELECT doc_id, CAST(min(k) AS BIGINT) AS found_in FROM (SELECT doc_id, 0 AS k FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, 2 FROM documents WHERE source = 'src1') GROUP BY 1"),
    "touched_files_union": (touched_files_union, f"WITH {T} SELECT path FROM touched WHERE change_type = 'A' UNION SELECT path FROM touched WHERE change_type = 'M'"),
    "manifest_diff": (manifest_diff, "WITH o AS (SELECT p_partkey AS path, p_size AS old FROM part WHERE p_partkey % 10 <> 0), n AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 10 = 2 THEN p_size + 1 ELSE p_size END AS new FROM part WHERE p_partkey % 10 <> 1) SELECT coalesce(o.path, n.path) AS path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'modified' ELSE 'unchanged' END AS state FROM o FULL JOIN n ON o.path = n.path"),
    "decoding_summary": (decoding_summary, """WITH r AS (SELECT page_id, coalesce(nullif(lower(regexp_extract(html, 'charset="?([A-Za-z0-9-]+)', 1)), ''), 'none') AS encoding, contains(html, chr(65533)) AS replaced FROM pages),
k AS (SELECT encoding, page_id, row_number() OVER (PARTITION BY encoding ORDER BY page_id) AS n FROM r)
SELECT r.encoding, count(*) AS pages, count(*) FILTER (replaced) AS replaced, (SELECT string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FROM k WHERE k.encoding = r.encoding AND n <= 5) AS samples FROM r GROUP BY 1"""),
    "peer_segments": (peer_segments, "WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS mean FROM customer GROUP BY 1) SELECT c.c_nationkey, count(*) AS n FROM customer c JOIN m ON m.c_nationkey = c.c_nationkey WHERE c_acctbal > mean GROUP BY 1"),
}
