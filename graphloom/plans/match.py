"""Pattern queries over the bound graph: the presets of the query surface and patterns with cycles and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import bind
from graphloom.operators.patterns import Graph
from graphloom.plans.derive import _DEP, depends_on_files
from graphloom.session import table

T, S = bind.TOUCHED_SQL, bind.SPRINTS_SQL


def graph(spark, d) -> Graph:
    """Commits, files, requirements, sprints, sources and documents with the edges between them."""
    day = F.to_date("ts")
    commits, sprints = bind.commits(spark, d).withColumnRenamed("hash", "id"), bind.sprints(spark, d)
    quarter = F.concat_ws("-", F.year(day), F.quarter(day))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    implements = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("flag"))
    return Graph(
        {
            "Commit": commits, "File": bind.files(spark, d).withColumnRenamed("path", "id"), "Sprint": sprints.withColumn("id", F.col("number")),
            "Requirement": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
            "Document": docs, "Source": docs.where("source IS NOT NULL").select(F.col("source").alias("id")).distinct(),
        },
        {
            "TOUCHED": bind.touches(spark, d).withColumnsRenamed({"hash": "src", "path": "dst"}), "INCLUDES": commits.select(quarter.alias("src"), F.col("id").alias("dst")),
            "IMPLEMENTS": implements.distinct(), "DEPENDS_ON": depends_on_files(spark, d), "HOLDS": docs.select(F.col("source").alias("src"), F.col("id").alias("dst")),
        },
        {"TOUCHED": ("Commit", "File"), "INCLUDES": ("Sprint", "Commit"), "IMPLEMENTS": ("Requirement", "File"), "DEPENDS_ON": ("File", "File"), "HOLDS": ("Source", "Document")},
    )


def pattern_recent(spark, d):
    """(c:Commit)-[r:TOUCHED]->(f:File), the last 25, as a subgraph."""
    return graph(spark, d).match("c", "Commit").out("TOUCHED", "r", "f").first(25, F.desc("r_ts"), F.desc("c_id"), F.desc("f_id")).fold().table()


def pattern_unimplemented(spark, d):
    """Requirements without an implementation by a line that was accepted."""
    return graph(spark, d).match("r", "Requirement").without("IMPLEMENTS", "flag = 'A'").rows.select(F.col("r_id").alias("id"), F.col("r_name").alias("name"))


def pattern_without_creation(spark, d):
    """(c:Commit) that touches files but creates none."""
    found = graph(spark, d).match("c", "Commit").without("TOUCHED", "change_type = 'A'").out("TOUCHED", "t", "f")
    return found.rows.groupBy(F.col("c_id").alias("id")).agg(F.count("f_id").alias("files"))


def pattern_lineage(spark, d):
    """(a:File)-[:DEPENDS_ON*1..3]->(b:File): every trail."""
    rows = graph(spark, d).match("a", "File").walk("DEPENDS_ON", "p", "b", 1, 3).rows
    return rows.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.array_join(F.col("p").cast("array<string>"), ">").alias("trail"))


def pattern_holdings(spark, d):
    """(s:Source)-[h:HOLDS]->(d:Document) of English documents: documents by source."""
    rows = graph(spark, d).match("s", "Source").out("HOLDS", "h", "d", to_where="lang = 'en'").rows
    return rows.groupBy(F.col("s_id").alias("source")).agg(F.count("d_id").alias("documents"))


def pattern_sprint(spark, d):
    """(s:Sprint)-[i:INCLUDES]->(c:Commit)-[t:TOUCHED]->(f:File), the last 50 by sprint, as a subgraph of at most
    60 nodes."""
    found = graph(spark, d).match("s", "Sprint").out("INCLUDES", "i", "c").out("TOUCHED", "t", "f")
    return found.first(50, F.desc("s_start"), "c_id", "f_id").fold(max_nodes=60).table()


def pattern_cycle(spark, d):
    """(r:Requirement)-[:IMPLEMENTS]->(f:File)-[:DEPENDS_ON]->(g:File)<-[:IMPLEMENTS]-(r): how many by requirement."""
    g = graph(spark, d)
    g = Graph(g.nodes, g.edges | {"IMPLEMENTS": g.edges["IMPLEMENTS"].select("src", "dst").distinct()}, g.ends)
    rows = g.match("r", "Requirement").out("IMPLEMENTS", "i", "f").out("DEPENDS_ON", "e", "g").back("IMPLEMENTS", "j", "r").rows
    return rows.groupBy(F.col("r_id").alias("id")).agg(F.count(F.lit(1)).alias("cycles"))


def pattern_co_touch(spark, d):
    """(f:File)<-[a:TOUCHED]-(c:Commit)-[b:TOUCHED]->(g:File) with a removal and a creation in one commit: pairs
    by how often. No edge is used twice, so no file meets itself."""
    found = graph(spark, d).match("f", "File").back("TOUCHED", "a", "c", "change_type = 'D'").out("TOUCHED", "b", "g", "change_type = 'A'")
    return found.rows.groupBy(F.col("f_id").alias("removed"), F.col("g_id").alias("created")).agg(F.count(F.lit(1)).alias("n"))


_FOLD = """SELECT 'node' AS kind, name, id, NULL AS src, NULL AS dst FROM n UNION ALL SELECT 'edge', name, NULL, src, dst FROM e"""
QUERIES = {
    "pattern_recent": (pattern_recent, f"""WITH {T}, m AS (SELECT * FROM touched JOIN orders ON o_orderkey = hash JOIN part ON p_partkey = path ORDER BY ts DESC, hash DESC, path DESC LIMIT 25),
n AS (SELECT DISTINCT 'Commit' AS name, CAST(hash AS VARCHAR) AS id FROM m UNION SELECT DISTINCT 'File', CAST(path AS VARCHAR) FROM m), e AS (SELECT 'TOUCHED' AS name, CAST(hash AS VARCHAR) AS src, CAST(path AS VARCHAR) AS dst FROM m) {_FOLD}"""),
    "pattern_unimplemented": (pattern_unimplemented, "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A')"),
    "pattern_without_creation": (pattern_without_creation, f"WITH {T} SELECT o_orderkey AS id, count(*) AS files FROM orders JOIN touched ON hash = o_orderkey JOIN part ON p_partkey = path WHERE o_orderkey NOT IN (SELECT hash FROM touched WHERE change_type = 'A') GROUP BY 1"),
    "pattern_lineage": (pattern_lineage, f"""WITH {_DEP}, dp AS (SELECT d.src, d.dst FROM dep d JOIN part a ON a.p_partkey = d.src), x1 AS (SELECT src AS a, dst AS b, src || '>' || dst AS trail, src AS s1, dst AS d1 FROM dp),
x2 AS (SELECT a, dst AS b, trail || '>' || dst AS trail, s1, d1, src AS s2, dst AS d2 FROM x1 JOIN dep ON src = x1.b WHERE (src, dst) <> (s1, d1)),
x3 AS (SELECT a, dst AS b, trail || '>' || dst AS trail FROM x2 JOIN dep ON src = x2.b WHERE (src, dst) <> (s1, d1) AND (src, dst) <> (s2, d2))
SELECT a, b, trail FROM (SELECT a, b, trail FROM x1 UNION ALL SELECT a, b, trail FROM x2 UNION ALL SELECT a, b, trail FROM x3) JOIN part ON p_partkey = b"""),
    "pattern_holdings": (pattern_holdings, "SELECT source, count(doc_id) AS documents FROM documents WHERE lang = 'en' AND source IS NOT NULL GROUP BY 1"),
    "pattern_sprint": (pattern_sprint, f"""WITH {T}, {S}, m AS (SELECT number, hash, path FROM sprints JOIN orders ON year(o_orderdate) || '-' || quarter(o_orderdate) = number JOIN touched ON hash = o_orderkey JOIN part ON p_partkey = path ORDER BY "start" DESC, hash, path LIMIT 50),
a AS (SELECT 'Sprint' AS name, number AS id FROM m UNION SELECT 'Commit', CAST(hash AS VARCHAR) FROM m UNION SELECT 'File', CAST(path AS VARCHAR) FROM m), n AS (SELECT * FROM a ORDER BY name, id LIMIT 60),
e AS (SELECT 'INCLUDES' AS name, number AS src, CAST(hash AS VARCHAR) AS dst FROM m UNION SELECT 'TOUCHED', CAST(hash AS VARCHAR), CAST(path AS VARCHAR) FROM m)
{_FOLD} UNION ALL SELECT 'warning', 'nodes truncated to 60', NULL, NULL, NULL WHERE (SELECT count(*) FROM a) > 60"""),
    "pattern_cycle": (pattern_cycle, f"WITH {_DEP}, i AS (SELECT DISTINCT l_suppkey AS r, l_partkey AS f FROM lineitem) SELECT x.r AS id, count(*) AS cycles FROM i x JOIN dep ON x.f = dep.src JOIN i y ON y.f = dep.dst AND y.r = x.r GROUP BY 1"),
    "pattern_co_touch": (pattern_co_touch, f"WITH {T} SELECT a.path AS removed, b.path AS created, count(*) AS n FROM touched a JOIN touched b ON a.hash = b.hash WHERE a.change_type = 'D' AND b.change_type = 'A' GROUP BY 1, 2"),
}
