"""Parsers over texts that the tables give: each supplier or part writes a manifest, a heading, a log, a module.

The given tables hold no logs, manifests or sources, so the texts are made from their columns, a row or a
group of rows at a time, and what the parsers find is held against the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import bind
from graphloom.functions import photos, scalars
from graphloom.functions import text as tx
from graphloom.operators import evidence as ev
from graphloom.plans.derive import _frame, _values
from graphloom.plans.extra import supplier_sources
from graphloom.session import table
from graphloom.sources import files as src

T = bind.TOUCHED_SQL


def _texts(spark, d, template: str):
    """(key, t): a text of each supplier; the template is an expression over s_suppkey (k) and s_name."""
    return table(spark, d, "supplier").withColumn("k", F.col("s_suppkey")).select(F.col("k").alias("key"), F.expr(template).alias("t"))


def _found(rows, parser, name: str = "r"):
    return rows.select("key", F.explode(parser(F.col("t"))).alias(name)).select("key", f"{name}.*")


def parse_requirements(spark, d):
    return _found(_texts(spark, d, r"concat('lib', k, '==1.', k, '\n# note\nFastAPI >= 0.', k % 9, '\n\npandas')"), src.requirements)


def parse_package(spark, d):
    return _found(_texts(spark, d, """concat('{"dependencies": {"lib', k, '": "^', k, '"}, "devDependencies": {"vite": "', k % 7, '"}}')"""), src.package_sections)


def parse_requirement_table(spark, d):
    template = r"concat('| ID | Text | Prio | More |\n|---|---|---|---|\n| FR-10-', lpad(k % 100, 2, '0'), ' | Text ', k, ' | high | x |\n| x | y |\n| NFR-02-03 | Fast | low | bench |')"
    return _found(_texts(spark, d, template), src.requirement_rows)


def parse_releases(spark, d):
    return _found(_texts(spark, d, r"concat('# Log\n## [1.', k % 10, '.', k % 7, '] - 2024-05-', lpad(1 + k % 28, 2, '0'), '\n- x\n## [0.0.1] - 2024-04-01\n## [next] - soon')"), src.releases)


STATUS = r"concat('# Sprints\n\n## Sprint ', k, ': Name ', k, '\n\nDates: 2024-01-01 to 2024-01-', lpad(2 + k % 27, 2, '0'), '\n- Goal: ship ', k, '\n* other\n## Sprint 7: Next\nNo dates\n  - second goal\n')"


def parse_sprints(spark, d):
    return _found(_texts(spark, d, STATUS), src.sprint_status)


def parse_bullets(spark, d):
    rows = _texts(spark, d, STATUS)
    return rows.select("key", F.explode(src.bullets(F.col("t"))).alias("bullet"))


def document_titles(spark, d):
    """Documents with a heading of level one, of level two or none, by turns."""
    stem = F.concat(F.lit("read_me-"), F.col("doc_id"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## Second\n# First "), "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("## Only "), "doc_id")).otherwise(F.lit("plain"))
    return table(spark, d, "documents").select("doc_id", src.title(text, stem).alias("title"))


MARKDOWN = r"concat('# Top\nintro\n## Setup\n', 'Install', repeat(' it', 20 + CAST(k % 5 AS INT)), '\n### Notes\nshort\n## Usage: run it!\nCall ', s_name, repeat(' again', 10))"


def _markdown(spark, d):
    return _texts(spark, d, MARKDOWN).select(F.concat("key", F.lit(".md")).alias("path"), F.col("t").alias("text"))


def chunk_markdown(spark, d):
    return tx.markdown_chunks(_markdown(spark, d)).select("id", "heading", F.length("chunk").alias("length"))


def chunk_slugs(spark, d):
    return tx.slug_chunks(_markdown(spark, d)).select("id", "level")


def code_symbols(spark, d):
    """Classes and methods of the suppliers' sources, and of files that cannot be parsed none."""
    broken = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".py")).alias("path"), F.lit("def (").alias("source"))
    return tx.python_symbols(supplier_sources(spark, d).unionAll(broken))


def code_imports(spark, d):
    source = F.expr(r"concat('import os\nfrom app.s', s_suppkey, ' import run\n\nx = 1\nimport lib', s_suppkey % 10, '\n')")
    return table(spark, d, "supplier").select(F.explode(tx.imports(source)).alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


def commit_log(spark, d):
    """Each customer's orders as a log, newest last, with the files that they touched; one log is ordered at a time."""
    c = bind.commits(spark, d).select("hash", F.col("author").alias("log"), "ts", "message")
    sha = F.substring(F.sha1(F.col("hash").cast("string")), 1, 10)
    head = c.select("log", "ts", "hash", F.lit(0).cast("long").alias("path"), F.concat_ws("\t", sha, F.col("log").cast("string"), F.lit("a@x.org"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "message").alias("line"))
    touched = bind.touches(spark, d).select("hash", (F.col("path") + 1).alias("path"), F.concat("change_type", F.lit("\tsrc/"), "path", F.lit(".py")).alias("line")).join(c.select("log", "ts", "hash"), "hash")
    lines = head.unionByName(touched).withColumn("k", F.row_number().over(Window.partitionBy("log").orderBy("ts", "hash", "path")))
    rows = src.commit_log(lines.select(F.col("log").cast("string").alias("log"), "k", "line"))
    return rows.select("hash", "author", "message", F.date_format("ts", "yyyy-MM-dd").alias("day"), "change_type", "path", "old_path")


def uuid5(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.uuid5_dns(F.concat_ws("/", "p_brand", "p_name", "p_partkey")).alias("id"))


def chunk_code(spark, d):
    return tx.code_chunks(supplier_sources(spark, d)).select("path", F.col("part").cast("int").alias("part"), "first", "last", "opening")


SCRIPT = r"concat('export class P', k, ' {}\ninterface I', k, ' { a: string }\nexport default function r', k, '(p) {}\nconst x = 1\nasync function l', k, '() {}\n')"


def typescript_symbols(spark, d):
    return _found(_texts(spark, d, SCRIPT), tx.ts_symbols)


PHOTO = "concat(p_name, ' 2017 canon #tag', p_partkey % 9, ' f/2.8 50mm iso', 100 * (1 + p_partkey % 4), ' 1/200s')"


def parse_query(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(PHOTO).alias("q"))
    return rows.select("id", *[c.alias(n) for n, c in tx.parse_photo_query(F.col("q")).items()])


#: Free queries of every form.
PHOTOS = [
    (1, "happy family 2017 strasbourg canon #vacation f/2.8 50mm iso100 1/200s"), (2, "Portrait May 2020 sigma tag:Kids kw:beach city=Paris f1.4 2s"),
    (3, "sunset iso: 800 camera_make:Nikon"), (4, "sunset"), (5, ""), (6, None),
]
_PHOTOS = [
    (1, "2017", None, "canon", "canon", "f/2.8", "50mm", "100", "1/200s", "vacation", None, None, "happy family strasbourg"),
    (2, "2020", "may", "sigma", "sigma", "f/1.4", None, None, "2s", "kids", "beach", "city=paris", "Portrait"),
    (3, None, None, "nikon", "nikon", None, None, None, None, None, None, "iso=800,camera_make=nikon", "sunset camera_make:"),
    (4, None, None, None, None, None, None, None, None, None, None, None, "sunset"), (5, *[None] * 11, ""), (6, *[None] * 12),
]
#: Queries of the parts, by turns of the key: words and settings, a month with labels and a named field, fields by name, no metadata, none.
FORMS = """CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ' 2017 canon #tag', p_partkey % 9, ' f/2.8 50mm iso', 100 * (1 + p_partkey % 4), ' 1/200s')
WHEN 1 THEN concat(p_name, ' May ', 1990 + p_partkey % 30, ' sigma tag:Kids', p_partkey % 9, ' kw:beach', p_partkey % 8, ' city=Paris', p_partkey % 7, ' f1.4 2s')
WHEN 2 THEN concat(p_name, ' iso: ', 100 * (1 + p_partkey % 4), ' camera_make:Nikon') WHEN 3 THEN p_name END"""


def photo_query(spark, d):
    """The free queries of every form, and one for each part."""
    parts = table(spark, d, "part").select((F.col("p_partkey") + 100).cast("long").alias("id"), F.expr(FORMS).alias("q"))
    rows = _frame(spark, PHOTOS, "id long, q string").unionAll(parts)
    return rows.select("id", *[c.alias(n) for n, c in photos.parse(F.col("q")).items()])


def import_graph(spark, d):
    """Each part as a module that imports two others, one by a name in it, and the standard library."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("concat('app/m', p_partkey, '.py')").alias("path"))
    asked = parts.select("path", F.explode(F.expr("array(concat('app.m', k div 2), concat('app.m', k div 3, '.run'), 'os')")).alias("module"))
    return src.import_edges(asked, parts.select("path"))


def mention_files(spark, d):
    """Commits that name the files they touch by full path, by the path below its first folder, or by base name, which
    two files share where the numbers fall together."""
    path = F.expr("concat('app/d', path % 7, '/f', path div 2, '.py')")
    files = bind.files(spark, d).select(path.alias("path"))
    named = bind.touches(spark, d).select("hash", path.alias("file"))
    term = F.when(F.col("hash") % 3 == 0, F.col("file")).when(F.col("hash") % 3 == 1, F.regexp_replace("file", "^app/", "")).otherwise(F.element_at(F.split("file", "/"), -1))
    return ev.mentioned_files(named.select(F.col("hash").alias("chunk"), term.alias("term")).distinct(), files)


#: Modules whose libraries have another name.
ALIASES = {"sklearn": "scikit-learn", "PIL": "pillow", "cv2": "opencv-python", "yaml": "pyyaml"}


def uses_library(spark, d):
    module = F.element_at(F.array(*map(F.lit, ["sklearn", "numpy", "PIL", "yaml", "react-dom", "cv2"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    name = F.coalesce(F.try_element_at(names, module), module)
    return table(spark, d, "part").select("p_partkey", name.alias("library"), scalars.title_case(name).alias("title"))


def dependency_changes(spark, d):
    """Added and removed libraries from the changed lines of manifests, a diff an order."""
    diff = F.expr(r"concat('+lib', o_orderkey, '==1.', o_orderkey % 5, '\n-    \"old_', o_orderkey % 7, '\": \"1\"\n context')")
    file = F.element_at(F.array(*map(F.lit, ["requirements.txt", "package.json", "notes.txt"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"), file.alias("file"), diff.alias("diff")).where("file IN ('requirements.txt', 'package.json')")
    lines = rows.select("hash", F.explode(F.split("diff", "\n")).alias("line")).where("line RLIKE '^[+-]'")
    lib = F.regexp_extract("line", r"^[+-]\s*\"?([A-Za-z0-9_.-]+)", 1)
    return lines.select("hash", lib.alias("library"), F.when(F.col("line").startswith("+"), "added").otherwise("removed").alias("change"))


def validate_changes(spark, d):
    """Why a file change is refused; null if it is fine."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ["A", "X", "R", "M"])), (k % 4 + 1).cast("int"))
    rows = table(spark, d, "part").select(k, F.when(k % 5 == 0, "").when(k % 5 > 1, F.col("p_name")).alias("path"), kind.alias("change_type"), F.when(k % 3 == 0, "old").alias("old_path"))
    why = (
        F.when(F.coalesce("path", F.lit("")) == "", "no path").when(~F.col("change_type").isin("A", "M", "D", "R"), "bad type")
        .when((F.col("change_type") == "R") & F.col("old_path").isNull(), "no old path")
    )
    return rows.select("p_partkey", "path", "change_type", why.alias("problem"))


_PY = """f AS (SELECT s_suppkey AS id, s_suppkey || '.py' AS path, unnest(range(s_suppkey % 7 + 1)) AS i FROM supplier)"""
QUERIES = {
    "parse_requirements": (parse_requirements, """SELECT s_suppkey AS key, 'lib' || s_suppkey AS library, '==1.' || s_suppkey AS "constraint" FROM supplier
UNION ALL SELECT s_suppkey, 'fastapi', '>= 0.' || s_suppkey % 9 FROM supplier UNION ALL SELECT s_suppkey, 'pandas', '' FROM supplier"""),
    "parse_package": (parse_package, "SELECT s_suppkey AS key, 'dependencies' AS section, 'lib' || s_suppkey AS library, '^' || s_suppkey AS version FROM supplier UNION ALL SELECT s_suppkey, 'devDependencies', 'vite', CAST(s_suppkey % 7 AS VARCHAR) FROM supplier"),
    "parse_requirement_table": (parse_requirement_table, "SELECT s_suppkey AS key, 'FR-10-' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS id, 'Text ' || s_suppkey AS description, 'high' AS priority FROM supplier UNION ALL SELECT s_suppkey, 'NFR-02-03', 'Fast', 'low' FROM supplier"),
    "parse_releases": (parse_releases, "SELECT s_suppkey AS key, '1.' || s_suppkey % 10 || '.' || s_suppkey % 7 AS version, '2024-05-' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR), 2, '0') AS date FROM supplier UNION ALL SELECT s_suppkey, '0.0.1', '2024-04-01' FROM supplier"),
    "parse_sprints": (parse_sprints, """SELECT s_suppkey AS key, CAST(s_suppkey AS VARCHAR) AS number, 'Name ' || s_suppkey AS name, '2024-01-01' AS start, '2024-01-' || lpad(CAST(2 + s_suppkey % 27 AS VARCHAR), 2, '0') AS "end" FROM supplier"""),
    "parse_bullets": (parse_bullets, "SELECT s_suppkey AS key, 'Goal: ship ' || s_suppkey AS bullet FROM supplier UNION ALL SELECT s_suppkey, 'second goal' FROM supplier"),
    "document_titles": (document_titles, "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'First ' || doc_id WHEN 1 THEN 'Only ' || doc_id ELSE 'Read Me ' || doc_id END AS title FROM documents"),
    "chunk_markdown": (chunk_markdown, """SELECT s_suppkey || '.md#1' AS id, 'Setup' AS heading, length('## Setup') + 1 + length('Install') + 3 * (20 + s_suppkey % 5) AS length FROM supplier
UNION ALL SELECT s_suppkey || '.md#2', 'Usage: run it!', length('## Usage: run it!') + 1 + length('Call ') + length(s_name) + 60 FROM supplier"""),
    "chunk_slugs": (chunk_slugs, "SELECT s_suppkey || '.md#' || s AS id, l AS level FROM supplier, (VALUES ('top-01', 1), ('setup-01', 2), ('notes-01', 3), ('usage-run-it-02', 2)) v(s, l)"),
    "code_symbols": (code_symbols, f"""WITH {_PY} SELECT path, path || '::class::S' || id || '_' || i AS symbol_id, 'S' || id || '_' || i AS name, 'class' AS kind, CAST(6 * i + 1 AS INTEGER) AS line, 'S' || id || '_' || i || '()' AS signature FROM f
UNION ALL SELECT path, path || '::method::S' || id || '_' || i || '.' || m, m, 'method', CAST(6 * i + o AS INTEGER), m || '(self)' FROM f, (VALUES ('area', 2), ('name', 5)) v(m, o)"""),
    "code_imports": (code_imports, "SELECT module, count(*) AS n FROM (SELECT 'os' AS module FROM supplier UNION ALL SELECT 'app.s' || s_suppkey FROM supplier UNION ALL SELECT 'lib' || s_suppkey % 10 FROM supplier) GROUP BY 1"),
    "commit_log": (commit_log, f"""WITH {T} SELECT substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 10) AS hash, CAST(o_custkey AS VARCHAR) AS author, o_orderpriority || ' ' || o_orderstatus AS message, strftime(o_orderdate, '%Y-%m-%d') AS day,
change_type, 'src/' || path || '.py' AS path, CAST(NULL AS VARCHAR) AS old_path FROM orders LEFT JOIN touched ON hash = o_orderkey"""),
    "uuid5": (uuid5, """WITH h AS (SELECT p_partkey, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(p_brand || '/' || p_name || '/' || p_partkey)) AS h FROM part)
SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(h, 17, 1) AS INTEGER) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h"""),
    "chunk_code": (chunk_code, f"WITH {_PY} SELECT path, CAST(i + 1 AS INTEGER) AS part, 6 * i AS first, 6 * i + 5 AS last, 'class S' || id || '_' || i || ':' AS opening FROM f"),
    "typescript_symbols": (typescript_symbols, "SELECT s_suppkey AS key, a AS kind, b || s_suppkey AS name FROM supplier, (VALUES ('class', 'P'), ('interface', 'I'), ('function', 'r'), ('function', 'l')) v(a, b)"),
    "parse_query": (parse_query, "SELECT p_partkey AS id, 2017 AS year, 2.8::DOUBLE AS aperture, 50 AS focal, 100 * (1 + p_partkey % 4) AS iso, '1/200' AS shutter, 'canon' AS brand, 'tag' || p_partkey % 9 AS tags, p_name AS rest FROM part"),
    "photo_query": (photo_query, f"""SELECT * FROM {_values(_PHOTOS)} v(id, year, month, camera_make, lens_make, aperture, focal_length, iso, shutter_speed, tags, keywords, fields, rest)
UNION ALL SELECT p_partkey + 100, '2017', NULL, 'canon', 'canon', 'f/2.8', '50mm', CAST(100 * (1 + p_partkey % 4) AS VARCHAR), '1/200s', 'tag' || p_partkey % 9, NULL, NULL, p_name FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey + 100, CAST(1990 + p_partkey % 30 AS VARCHAR), 'may', 'sigma', 'sigma', 'f/1.4', NULL, NULL, '2s', 'kids' || p_partkey % 9, 'beach' || p_partkey % 8, 'city=paris' || p_partkey % 7, p_name FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey + 100, NULL, NULL, 'nikon', 'nikon', NULL, NULL, NULL, NULL, NULL, NULL, 'iso=' || 100 * (1 + p_partkey % 4) || ',camera_make=nikon', p_name || ' camera_make:' FROM part WHERE p_partkey % 5 = 2
UNION ALL SELECT p_partkey + 100, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_partkey % 5 = 3 THEN p_name END FROM part WHERE p_partkey % 5 > 2"""),
    "import_graph": (import_graph, "SELECT 'app/m' || k || '.py' AS src, 'app/m' || t || '.py' AS dst, count(*) AS weight FROM (SELECT p_partkey AS k, unnest([p_partkey // 2, p_partkey // 3]) AS t FROM part) WHERE t <> k GROUP BY 1, 2"),
    "mention_files": (mention_files, f"""WITH {T}, f AS (SELECT 'app/d' || p_partkey % 7 || '/f' || p_partkey // 2 || '.py' AS path, 'd' || p_partkey % 7 || '/f' || p_partkey // 2 || '.py' AS below, 'f' || p_partkey // 2 || '.py' AS base FROM part),
m AS (SELECT DISTINCT hash AS chunk, CASE hash % 3 WHEN 0 THEN 'app/' ELSE '' END || CASE WHEN hash % 3 < 2 THEN 'd' || path % 7 || '/' ELSE '' END || 'f' || path // 2 || '.py' AS term FROM touched),
u AS (SELECT base, min(path) AS path FROM f GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT chunk, path, 1.0::DOUBLE AS c FROM m JOIN f ON term = path UNION ALL SELECT chunk, path, 0.95::DOUBLE FROM m JOIN f ON term = below UNION ALL SELECT chunk, path, 0.7::DOUBLE FROM m JOIN u ON regexp_extract(term, '([^/]+)$', 1) = base)
SELECT chunk, path, max(c) AS confidence FROM x GROUP BY 1, 2"""),
    "uses_library": (uses_library, """WITH u AS (SELECT p_partkey, (['scikit-learn', 'numpy', 'pillow', 'pyyaml', 'react-dom', 'opencv-python'])[p_partkey % 6 + 1] AS library FROM part)
SELECT p_partkey, library, array_to_string(list_transform(string_split_regex(library, '[-_]+'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM u"""),
    "dependency_changes": (dependency_changes, "SELECT o_orderkey AS hash, 'lib' || o_orderkey AS library, 'added' AS change FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, 'old_' || o_orderkey % 7, 'removed' FROM orders WHERE o_orderkey % 3 < 2"),
    "validate_changes": (validate_changes, """WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 > 1 THEN p_name END AS path, (['A', 'X', 'R', 'M'])[p_partkey % 4 + 1] AS change_type, CASE WHEN p_partkey % 3 = 0 THEN 'old' END AS old_path FROM part)
SELECT p_partkey, path, change_type, CASE WHEN coalesce(path, '') = '' THEN 'no path' WHEN change_type = 'X' THEN 'bad type' WHEN change_type = 'R' AND old_path IS NULL THEN 'no old path' END AS problem FROM c"""),
}
