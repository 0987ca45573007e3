"""Graph analytics, lineage, hierarchy and presets."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import bind
from graphloom.operators import evidence as ev
from graphloom.operators import graphs, louvain
from graphloom.plans.derive import _DEP, depends_on_files
from graphloom.plans.relational import _PATHS_SQL, _paths
from graphloom.session import table

T = bind.TOUCHED_SQL


def _edges(spark, d):
    """The whole undirected graph: each commit with the files it touched, each requirement with the files
    that implement it and with the commits that do so. Ids are unfolded: 4 * key, plus 0 for a file, 1 for
    a commit, 2 for a requirement."""
    li = table(spark, d, "lineitem")
    node = lambda key, kind: (F.col(key).cast("long") * 4 + kind)
    commit, file, requirement = node("l_orderkey", 1), node("l_partkey", 0), node("l_suppkey", 2)
    return graphs.undirected(li.select(F.explode(F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in ((commit, file), (requirement, file), (commit, requirement))])).alias("e")).select("e.src", "e.dst"))


_EDGES = """ed AS (SELECT DISTINCT least(s, t) AS lo, greatest(s, t) AS hi FROM (SELECT 4 * l_orderkey + 1 AS s, 4 * l_partkey AS t FROM lineitem
  UNION ALL SELECT 4 * l_suppkey + 2, 4 * l_partkey FROM lineitem UNION ALL SELECT 4 * l_orderkey + 1, 4 * l_suppkey + 2 FROM lineitem)),
dg AS (SELECT id, count(*) AS degree FROM (SELECT lo AS id FROM ed UNION ALL SELECT hi FROM ed) GROUP BY 1)"""


def degree_centrality(spark, d):
    deg = graphs.degrees(_edges(spark, d))
    return deg.join(F.broadcast(deg.agg(F.count(F.lit(1)).alias("n")))).select("id", "degree", F.round(F.col("degree") / (F.col("n") - 1), 6).alias("centrality"))


def central_nodes(spark, d):
    return graphs.degrees(_edges(spark, d)).orderBy(F.desc("degree"), "id").limit(10)


def graph_density(spark, d):
    e = _edges(spark, d)
    n = graphs.degrees(e).agg(F.count(F.lit(1)).alias("n"))
    return e.agg(F.count(F.lit(1)).alias("m")).join(n).select("n", "m", F.round(F.col("m") / (F.col("n") * (F.col("n") - 1) / 2), 6).alias("density"), F.round(2 * F.log("n"), 6).alias("path_length"))


def clustering_coefficient(spark, d):
    return graphs.clustering_coefficient(_edges(spark, d)).select(F.round("clustering", 6).alias("clustering"))


def triangle_counts(spark, d):
    return graphs.triangles(_edges(spark, d))


def modularity(spark, d):
    e = _edges(spark, d)
    parts = graphs.degrees(e).select("id", (F.col("id") % 10).alias("part"))
    return graphs.modularity(e, parts).select(F.round("modularity", 6).alias("modularity"))


def communities(spark, d):
    """Label propagation in five rounds over the whole graph."""
    return graphs.label_propagation(_edges(spark, d))


def louvain_communities(spark, d):
    """Louvain communities of the whole graph."""
    return louvain.louvain(_edges(spark, d))


def ring_layout(spark, d):
    """Coordinates from the first eight hex digits of MD5: an angle, and a ring by depth."""
    h = F.conv(F.substring(F.md5(F.col("path").cast("string")), 1, 8), 16, 10).cast("double")
    angle, ring = h / 4294967295.0 * 2 * F.pi(), 100 + 50 * (F.col("loc") % 3)
    return bind.files(spark, d).select("path", F.round(ring * F.cos(angle), 4).alias("x"), F.round(ring * F.sin(angle), 4).alias("y"))


def directory_tree(spark, d):
    """All folders above each file with depth, and the edges that contain them."""
    full = F.concat_ws("/", F.lit("src"), F.lower(F.replace("dir", F.lit("#"), F.lit(""))), F.lower("language"), F.concat(F.col("path").cast("string"), F.lit(".py")))
    parts = F.split(full, "/")
    rows = bind.files(spark, d).select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(2), F.size("p"))).alias("k"))
    child = F.array_join(F.slice("p", F.lit(1), F.col("k")), "/")
    parent = F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), "/")
    return rows.select(parent.alias("parent"), child.alias("child"), (F.col("k") - 1).cast("long").alias("depth")).distinct()


def dir_contains(spark, d):
    """Region, nation and their customers and suppliers as one hierarchy."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    rn = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit(1).alias("depth"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.col("c_name").alias("child"), F.lit(2).alias("depth"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name", F.lit(2))
    return rn.unionAll(c).unionAll(s)


def expansion_types(spark, d):
    """Labels next to files in either direction, by how many edges lead there."""
    t = bind.touches(spark, d).select(F.lit("File").alias("a"), F.lit("Commit").alias("b"))
    i = table(spark, d, "lineitem").select(F.lit("Requirement").alias("a"), F.lit("File").alias("b"))
    e = t.unionAll(i)
    both = e.unionAll(e.select("b", "a"))
    return both.where("a = 'File' AND b <> 'File'").groupBy(F.col("b").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def lineage(spark, d):
    """Files reached from three roots over strong dependencies in at most five steps."""
    dep = depends_on_files(spark, d).select("src", "dst")
    roots = dep.select(F.col("src").alias("id")).distinct().orderBy("id").limit(3)
    return graphs.reachable(dep, roots, 5).select("root", "id", F.col("depth").cast("long").alias("depth"))


def file_history(spark, d):
    """Touches of a file and of the names it had before: renames are followed backwards."""
    renames = bind.files(spark, d).where("path % 7 = 0 AND path > 0").select(F.col("path").alias("src"), (F.col("path") - 7).alias("dst"))
    names = graphs.reachable(renames, bind.files(spark, d).where("path IN (70, 140)").select(F.col("path").alias("id")), 4)
    return names.join(bind.touches(spark, d), F.col("id") == F.col("path")).select("root", "path", F.col("depth").cast("long").alias("depth"), "hash", "ts", "change_type")


def co_occurs(spark, d):
    return graphs.co_occurrence(bind.touches(spark, d), "hash", "path")


def co_occurs_directed(spark, d):
    pairs = graphs.co_occurrence(bind.touches(spark, d), "hash", "path")
    return pairs.unionAll(pairs.select("b", "a", "n"))


def heading_relates(spark, d):
    """Headings of one kind that hold a heading of the other, either way round."""
    docs = table(spark, d, "nation").select(F.regexp_replace(F.lower("n_name"), "nation_", "").alias("heading"), F.col("n_nationkey").alias("doc"))
    code = bind.files(spark, d).select(F.concat(F.lit("n"), "path").alias("title"), F.col("path").alias("code"))
    down = ev.contained(docs, "heading", code, "title").select("doc", "code")
    up = ev.contained(code, "title", docs, "heading").select("doc", "code")
    return down.unionAll(up).distinct()


def requirement_in_path(spark, d):
    """Requirements whose number stands in a file's path."""
    reqs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("req"), F.concat(F.lit("_"), "s_suppkey", F.lit(".")).alias("needle"))
    return ev.contained(reqs, "needle", _paths(spark, d), "file").select("req", "path")


def preset_recent_touches(spark, d):
    return bind.touches(spark, d).orderBy(F.desc("ts"), F.desc("hash"), F.desc("path")).limit(200).select("hash", "path", "ts")


def preset_unimplemented(spark, d):
    impl = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(impl, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


def preset_docs_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "chunk"))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.length("chunk").cast("long").alias("length"))


def next_turns(spark, d):
    """Conversation turns with the role before and after."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


def link_graph(spark, d):
    """Links of pages: page to target with the number of times."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1))
    return table(spark, d, "pages").select("page_id", href.alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "degree_centrality": (degree_centrality, f"WITH {_EDGES} SELECT id, degree, round(degree / ((SELECT count(*) FROM dg) - 1), 6) AS centrality FROM dg"),
    "central_nodes": (central_nodes, f"WITH {_EDGES} SELECT * FROM dg ORDER BY degree DESC, id LIMIT 10"),
    "graph_density": (graph_density, f"WITH {_EDGES}, c AS (SELECT (SELECT count(*) FROM dg) AS n, (SELECT count(*) FROM ed) AS m) SELECT n, m, round(m / (n * (n - 1) / 2), 6) AS density, round(2 * ln(n), 6) AS path_length FROM c"),
    "clustering_coefficient": (clustering_coefficient, f"WITH {_EDGES}, bo AS (SELECT lo AS u, hi AS v FROM ed UNION ALL SELECT hi, lo FROM ed), tr AS (SELECT x.u AS id, count(*) AS t FROM bo x JOIN bo y ON x.u = y.u AND x.v < y.v JOIN ed ON ed.lo = x.v AND ed.hi = y.v GROUP BY 1) SELECT round(avg(CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END), 6) AS clustering FROM dg LEFT JOIN tr USING (id)"),
    "triangle_counts": (triangle_counts, f"WITH {_EDGES}, bo AS (SELECT lo AS u, hi AS v FROM ed UNION ALL SELECT hi, lo FROM ed) SELECT x.u AS id, count(*) AS triangles FROM bo x JOIN bo y ON x.u = y.u AND x.v < y.v JOIN ed ON ed.lo = x.v AND ed.hi = y.v GROUP BY 1"),
    "modularity": (modularity, f"WITH {_EDGES}, m AS (SELECT count(*) AS m FROM ed), i AS (SELECT lo % 10 AS p, count(*) AS k FROM ed WHERE lo % 10 = hi % 10 GROUP BY 1), t AS (SELECT id % 10 AS p, sum(degree) AS d FROM dg GROUP BY 1) SELECT round(sum(coalesce(k, 0) / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM t LEFT JOIN i USING (p), m"),
    "communities": (communities, None),
    "louvain_communities": (louvain_communities, None),
    "ring_layout": (ring_layout, "WITH h AS (SELECT p_partkey AS path, CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE * 2 * pi() AS a, 100 + 50 * (p_size % 3) AS r FROM part) SELECT path, round(r * cos(a), 4) AS x, round(r * sin(a), 4) AS y FROM h"),
    "directory_tree": (directory_tree, "WITH f AS (SELECT 'src/' || lower(replace(p_brand, '#', '')) AS a, lower(p_type) AS b, p_partkey || '.py' AS c FROM part) SELECT DISTINCT 'src' AS parent, a AS child, 1::BIGINT AS depth FROM f UNION SELECT a, a || '/' || b, 2 FROM f UNION SELECT a || '/' || b, a || '/' || b || '/' || c, 3 FROM f"),
    "dir_contains": (dir_contains, "SELECT r_name AS parent, n_name AS child, 1 AS depth FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name, c_name, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT n_name, s_name, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey"),
    "expansion_types": (expansion_types, f"WITH {T} SELECT 'Commit' AS label, count(*) AS n FROM touched UNION ALL SELECT 'Requirement', count(*) FROM lineitem"),
    "lineage": (lineage, f"WITH RECURSIVE {_DEP}, r0 AS (SELECT DISTINCT src FROM dep ORDER BY 1 LIMIT 3), r AS (SELECT src AS root, src AS id, 0 AS depth FROM r0 UNION SELECT r.root, dep.dst, r.depth + 1 FROM r JOIN dep ON dep.src = r.id WHERE r.depth < 5) SELECT root, id, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1, 2"),
    "file_history": (file_history, f"WITH RECURSIVE {T}, r AS (SELECT p_partkey AS root, p_partkey AS id, 0 AS depth FROM part WHERE p_partkey IN (70, 140) UNION SELECT root, id - 7, depth + 1 FROM r WHERE depth < 4 AND id % 7 = 0 AND id > 0) SELECT root, path, CAST(depth AS BIGINT) AS depth, hash, ts, change_type FROM r JOIN touched ON path = id"),
    "co_occurs": (co_occurs, f"WITH {T} SELECT x.path AS a, y.path AS b, count(*) AS n FROM touched x JOIN touched y ON x.hash = y.hash AND x.path < y.path GROUP BY 1, 2 HAVING count(*) > 1"),
    "co_occurs_directed": (co_occurs_directed, f"WITH {T} SELECT x.path AS a, y.path AS b, count(*) AS n FROM touched x JOIN touched y ON x.hash = y.hash AND x.path <> y.path GROUP BY 1, 2 HAVING count(*) > 1"),
    "heading_relates": (heading_relates, "WITH d AS (SELECT replace(lower(n_name), 'nation_', '') AS h, n_nationkey AS doc FROM nation), c AS (SELECT 'n' || p_partkey AS t, p_partkey AS code FROM part) SELECT doc, code FROM d JOIN c ON contains(t, h) OR contains(h, t)"),
    "requirement_in_path": (requirement_in_path, f"WITH {_PATHS_SQL} SELECT s_suppkey AS req, path FROM supplier JOIN paths ON contains(file, '_' || s_suppkey || '.')"),
    "preset_recent_touches": (preset_recent_touches, f"WITH {T} SELECT hash, path, ts FROM touched ORDER BY ts DESC, hash DESC, path DESC LIMIT 200"),
    "preset_unimplemented": (preset_unimplemented, "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A')"),
    "preset_docs_chunks": (preset_docs_chunks, "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS ordinal, length(unnest(s)) AS length FROM x"),
    "next_turns": (next_turns, "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)"),
    "link_graph": (link_graph, "WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM h GROUP BY 1, 2"),
}
