"""Code spans, commit analysis, photo queries, label search, quality categories, approximate search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom import bind
from graphloom.functions import code, photos, scalars
from graphloom.functions import text as tx
from graphloom.functions.scratch import scratch_dir
from graphloom.operators import ann, inverted
from graphloom.operators import evidence as ev
from graphloom.plans import ad_hoc
from graphloom.plans.derive import _FACTS, _facts, _frame, _values
from graphloom.session import table
from graphloom.sources import sinks

PYTHON = 'import os\n\nclass Store:\n    """Keeps rows under their keys."""\n\n    def put(self, key, row):\n        self.rows[key] = row\n        return self\n\n\ndef main(argv):\n    store = Store()\n    return store.put(argv[0], argv[1])\n# the end of a file that has some more lines below its functions\nprint("a line that no definition covers, long enough")\n'
SCRIPT = "export class Page extends Base implements Shown, Kept {\n  render(props: Props): Node {\n    if (props) { return draw(props) }\n    return null\n  }\n}\ninterface Props extends Any { a: string }\nexport default function load(url) {\n  return fetch(url).then((x) => x.json())\n}\nexport const pick = async (a, b) => a\nconst one = x => x\n"
CHANGES = [
    ("c1", "FR-10-01 for sprint-4", "src/a.py", None, True, False, False, "@@\n+x = 1\n+# NFR-02-03", "x = 1\n# NFR-02-03\n"),
    ("c1", "FR-10-01 for sprint-4", "docs/FR-11-02.md", None, False, False, False, "@@\n-old\n+new\n same", "new\nFR-99-99"),
    ("c2", None, "src/b.ts", "src/old.ts", False, False, True, None, "// Sprint-7"), ("c3", "drop it", "src/c.py", None, False, True, False, "@@\n-a\n-b", None),
]


def supplier_sources(spark, d):
    """Each supplier as a Python file of one to seven classes with two methods each: path, source."""
    block = """concat('class S', s_suppkey, '_', i, ':\\n    def area(self):\\n        return ', s_acctbal, ' * ', i, '\\n\\n    def name(self):\\n        return "', s_name, '"')"""
    source = F.expr(f"array_join(transform(sequence(0, CAST(s_suppkey % 7 AS INT)), i -> {block}), '\\n')")
    return table(spark, d, "supplier").select(F.concat("s_suppkey", F.lit(".py")).alias("path"), source.alias("source"))


def code_spans(spark, d):
    """Classes and methods of the files that the suppliers give."""
    return code.code_spans(supplier_sources(spark, d), least=20).select("path", "first", "until", "kind", "symbol", F.length("text").alias("length"))


def document_spans(spark, d):
    """Windows over whole documents, cut at blank lines: no definitions, so windows alone."""
    docs = table(spark, d, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("source"))
    return code.code_spans(docs).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("first").alias("firsts"), F.sum("until").alias("untils"))


def typescript_details(spark, d):
    return _frame(spark, [(SCRIPT,)], "source string").select(F.explode(code.typescript_symbols(F.col("source"))).alias("s")).select("s.*")


#: Rows of a task of photo_properties().
PHOTOS = 10_000


def photo_properties(spark, d):
    """Each part as a photo whose metadata follow from its columns."""
    text = lambda c: F.col(c).cast("string")
    day = F.date_add(F.lit("2015-01-01").cast("date"), F.col("p_partkey").cast("int") % 3000)
    raw = {
        "FNumber": (F.col("p_size") / 10).cast("string"), "Make": F.col("p_brand"), "LensModel": F.col("p_type"), "CameraSerialNumber": text("p_partkey"),
        "FocalLength": text("p_size"), "ExposureProgram": (F.col("p_size") % 11).cast("string"), "ISO": F.when(F.col("p_size") % 2 == 0, text("p_size")),
        "WhiteBalance": (F.col("p_size") % 3).cast("string"), "DateTimeOriginal": F.concat(F.date_format(day, "yyyy:MM:dd"), F.lit(" 10:11:12.50")), "Other": text("p_name"),
    }
    raw = F.create_map(*[x for name, value in raw.items() for x in (F.lit(name), value)])
    parts = table(spark, d, "part")
    # A small file is one task as it stands; the map is a column of its own, so that it is made once a row.
    rows = parts.repartition(max(1, -(-parts.count() // PHOTOS))).select(F.col("p_partkey").alias("id"), raw.alias("raw"))
    return rows.select("id", F.explode(photos.properties(F.col("raw"))).alias("key", "value"))


def decode_documents(spark, d):
    """Every document from its bytes, in three encodings by turns, composed: what came out and how it was read."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), body)).when(F.col("doc_id") % 3 == 1, body).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    return rows.select("doc_id", tx.decode_any(content).alias("d")).select("doc_id", F.md5("d.text").alias("digest"), "d.encoding", "d.replaced")


def renamed_files(spark, d):
    """Line items that are returned count as renames: a part becomes the one after it."""
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("hash"), F.lit("R").alias("change_type"), (F.col("l_partkey") + 1).alias("path"), F.col("l_partkey").alias("old_path"), F.col("l_shipdate").alias("ts")
    )
    return ev.renames(rows)


def ad_hoc_sql(spark, d):
    """One read-only statement over the bound views."""
    ad_hoc.register_views(spark, d)
    return ad_hoc.read_only(spark, "SELECT change_type, count(*) AS n, count(DISTINCT hash) AS commits FROM touches GROUP BY change_type")


def sink_round_trip(spark, d):
    """Documents written in every format, partitioned by language, and read back."""
    rows, out = table(spark, d, "documents").select("doc_id", "n_chars", "lang"), None
    for kind in ("parquet", "json", "csv", "orc"):
        path = f"{scratch_dir(spark)}/sink-{kind}-{uuid.uuid4().hex}"
        sinks.write(rows, path, kind, ["lang"])
        back = spark.read.schema("doc_id long, n_chars long, lang string").format(kind).option("header", "true").load(path)
        one = back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).select(F.lit(kind).alias("kind"), "lang", "n", "chars")
        out = one if out is None else out.unionAll(one)
    return out


def commit_analysis(spark, d):
    rows = code.change_analysis(_frame(spark, CHANGES, "hash string, message string, path string, old_path string, is_new boolean, is_deleted boolean, is_renamed boolean, diff string, content string"))
    return rows.select("hash", "path", "old_path", "change_type", "additions", "deletions", "loc_after", F.array_join("requirements", ",").alias("requirements"), F.array_join("sprints", ",").alias("sprints"))


def attempt_flags(spark, d):
    """Documents that speak of work in progress, a spike or an attempt, by source."""
    rows = table(spark, d, "documents").select("source", code.is_attempt(F.col("text")).alias("attempt"))
    return rows.groupBy("source").agg(F.count_if("attempt").alias("attempts"), F.count(F.lit(1)).alias("n"))


def chunk_links(spark, d):
    """Inverse edges of PART_OF that are not there yet; requirements without a parent get the documents
    whose chunks mention them (lines that were accepted), and the others the sprint whose number stands in
    their id."""
    li = table(spark, d, "lineitem")
    part_of = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("src"), F.col("source").alias("dst"))
    there = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("dst")).distinct()
    contains = part_of.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src IS NOT NULL").join(there, "dst", "left_anti").select(F.lit("CONTAINS_CHUNK").alias("type"), "src", "dst")
    number = F.lpad((F.col("s_suppkey") % 40).cast("string"), 2, "0")
    reqs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "FR-").otherwise("NFR-"), number, F.lit("-"), F.col("s_suppkey")).alias("id"))
    mentions = li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").cast("string").alias("doc")).distinct()
    by_doc = reqs.join(mentions, "key").select(F.lit("PART_OF").alias("type"), F.col("id").alias("src"), F.col("doc").alias("dst"))
    sprint = F.regexp_extract("id", "^N?FR-([0-9]{2})", 1).cast("int").cast("string")
    sprints = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("dst"))
    by_sprint = reqs.join(mentions, "key", "left_anti").select(F.col("id").alias("src"), sprint.alias("dst")).join(sprints, "dst").select(F.lit("PART_OF").alias("type"), "src", "dst")
    return contains.unionByName(by_doc).unionByName(by_sprint)


def halved_batches(spark, d):
    """Batches of documents by the thousand ids; those over 200,000 bytes are split in half until they fit."""
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 1000).alias("grp"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    split = sinks.halved(rows, ["grp"], "doc_id", "bytes", 200_000)
    return split.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("doc_id").alias("first"))


def fulltext_labels(spark, d):
    """Files, requirements, commits and chunks in one search, read from the kept index. A node found twice under
    one id counts once, under the label with the better hit."""
    found = inverted.matches(bind.search_index(spark, d), ["the", "ECONOMY", "urgent", "red"]).withColumnRenamed("hits", "score")
    best = found.groupBy("id").agg(F.max_by(F.struct("label", "matched", "score"), F.struct("matched", "score", "label")).alias("best"))
    return best.select("id", "best.*").orderBy(F.desc("matched"), F.desc("score"), "id").limit(200)


def bm25_search(spark, d):
    """The 50 best nodes of any kind for some words, by BM25."""
    return inverted.search(bind.search_index(spark, d), "the economy, URGENT red anodized: thes", 50).select("label", "id", F.round("score", 6).alias("score"), "matched", "hits")


def bm25_rare(spark, d):
    """The ten best for two frequent and one rare word."""
    return inverted.search(bind.search_index(spark, d), "the of unconscionable thes", 10).select("label", "id", F.round("score", 6).alias("score"), "matched", "hits")


def term_statistics(spark, d):
    """Terms by the number of nodes that have them, from the index's own tables: the hundred most frequent."""
    tops = bind.search_index(spark, d).table("tops")
    return tops.groupBy("term").agg(F.sum("df").alias("df"), F.round(F.max("top"), 6).alias("top")).orderBy(F.desc("df"), "term").limit(100)


def quality_database(spark, d):
    """The database category: volume (35), consistency (35) and indexes (30); all tables have constraints and
    the vectors an index."""
    f, c, clamp = _facts(spark, d), F.col, scalars.clamp
    # Points by volume, and the shares of the sections.
    volume = c("commits") + c("files") + c("vectors") + c("reqs") + c("docs")
    points = F.lit(12.0)
    for least, score in ((200, 18.0), (1000, 24.0), (5000, 28.0), (20_000, 32.0), (50_000, 35.0)):
        points = F.when(volume >= least, score).otherwise(points)
    missing, orphan = c("missing") / F.greatest(F.lit(1), c("touched") + c("impl")), c("orphans") / F.greatest(F.lit(1), c("nodes"))
    consistency = clamp((1 - clamp(missing * 0.5 + orphan * 2.0, 0, 1)) * 35, 0, 35)
    present = sum(F.when(c(n) > 0, 1).otherwise(0) for n in ("commits", "files", "reqs", "docs", "vectors"))
    index = clamp(12 + F.when(c("vectors") > 0, 10).otherwise(0) + clamp(present / 5 * 8, 0, 8), 0, 30)
    rows = F.array(*[F.struct(F.lit(n).alias("section"), F.round(v, 2).alias("score"), F.lit(m).alias("max_score")) for n, v, m in (("volume", points, 35), ("consistency", consistency, 35), ("indexes", index, 30))])
    return f.select(F.explode(rows).alias("s")).select("s.*")


def quality_api(spark, d):
    """The API category from the event log: responsiveness (40) from the mean of the values, taken as
    milliseconds, caching (30) from the share of views, stability (30) from the number of samples; the
    memory of the process is not in the log and counts as under 1 GB."""
    e = table(spark, d, "events").agg(F.avg(F.col("value").cast("double")).alias("ms"), (F.count_if(F.col("event_type") == "view") / F.count(F.lit(1))).alias("hits"), F.count(F.lit(1)).alias("samples"))
    # Points by mean latency.
    points = F.lit(8.0)
    for most, score in ((500, 14.0), (350, 20.0), (220, 28.0), (140, 34.0), (80, 40.0)):
        points = F.when(F.col("ms") <= most, score).otherwise(points)
    points = F.when(F.col("ms") <= 0, 28.0).otherwise(points)
    caching, stability = scalars.clamp(F.col("hits"), 0, 1) * 30, scalars.clamp(scalars.clamp(F.col("samples") / 180, 0, 1) * 18 + 12, 0, 30)
    rows = F.array(*[F.struct(F.lit(n).alias("section"), F.round(v, 2).alias("score"), F.lit(m).alias("max_score")) for n, v, m in (("responsiveness", points, 40), ("caching", caching, 30), ("stability", stability, 30))])
    return e.select(F.explode(rows).alias("s")).select("s.*")


def ann_search(spark, d):
    """Each hundredth vector against an inverted file over all of them, with so many cells opened as a recall of
    0.95 takes; the tests measure recall on this table."""
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index, centres = ann.build(points)
    return ann.search(index, centres, points.where("id % 100 = 0"), k=10)


_SYMBOLS = [
    ("class", "Page", "Base", "Shown, Kept"), ("interface", "Props", "Any", None), ("function", "load", "(url)", None), ("arrow", "pick", "(a, b)", None), ("arrow", "one", "x", None),
    ("method", "render", "(props: Props)", None),
]
_ANALYSIS = [
    ("c1", "src/a.py", None, "A", 2, 0, 2, "FR-10-01,NFR-02-03", "4"), ("c1", "docs/FR-11-02.md", None, "M", 1, 1, 2, "FR-10-01,FR-11-02", "4"),
    ("c2", "src/b.ts", "src/old.ts", "R", 0, 0, 1, "", "7"), ("c3", "src/c.py", None, "D", 0, 2, 0, "", ""),
]

_BM25 = r"""x AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'File' AS label, p_name || ' ' || p_type AS text FROM part UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'Requirement', s_name FROM supplier
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'GitCommit', o_orderpriority FROM orders UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Chunk', text FROM documents),
w AS (SELECT label, id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM x),
l AS (SELECT label, id, count(*) AS len FROM w GROUP BY 1, 2), a AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
p AS (SELECT label, id, term, count(*) AS tf FROM w GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT label, id, term, tf, df, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) AS weight, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS rarity FROM p JOIN l USING (label, id) JOIN f USING (term), a)"""


def _best(*terms: str, limit: int) -> str:
    asked = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT label, id, round(sum(weight * rarity), 6) AS score, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS hits FROM s
WHERE term IN ({asked}) GROUP BY 1, 2 ORDER BY round(sum(weight * rarity), 9) DESC, label, id LIMIT {limit}"""


QUERIES = {
    "bm25_search": (bm25_search, f"WITH {_BM25} {_best('the', 'economy', 'urgent', 'red', 'anodized', 'thes', limit=50)}"),
    "bm25_rare": (bm25_rare, f"WITH {_BM25} {_best('the', 'of', 'unconscionable', 'thes', limit=10)}"),
    "term_statistics": (term_statistics, f"WITH {_BM25} SELECT term, max(df) AS df, round(max(weight), 6) AS top FROM s GROUP BY 1 ORDER BY df DESC, term LIMIT 100"),
    "renamed_files": (renamed_files, "SELECT l_partkey AS src, l_partkey + 1 AS dst, arg_min(l_orderkey, (l_shipdate, l_orderkey)) AS hash, min(l_shipdate) AS ts FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2"),
    "ad_hoc_sql": (ad_hoc_sql, f"WITH {bind.TOUCHED_SQL} SELECT change_type, count(*) AS n, count(DISTINCT hash) AS commits FROM touched GROUP BY 1"),
    "sink_round_trip": (sink_round_trip, "SELECT kind, lang, count(*) AS n, sum(n_chars) AS chars FROM documents, (VALUES ('parquet'), ('json'), ('csv'), ('orc')) v(kind) GROUP BY 1, 2"),
    "photo_properties": (photo_properties, """WITH p AS (SELECT p_partkey AS id, [
 {'k': 'aperture', 'v': printf('f/%.1f', p_size / 10)}, {'k': 'camera_make', 'v': lower(p_brand)}, {'k': 'lens_model', 'v': lower(p_type)}, {'k': 'camera_serial', 'v': CAST(p_partkey AS VARCHAR)},
 {'k': 'focal_length', 'v': p_size || 'mm'}, {'k': 'iso', 'v': CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END},
 {'k': 'exposure_program', 'v': coalesce((['Not Defined', 'Manual', 'Normal', 'Aperture Priority', 'Shutter Priority', 'Creative', 'Action', 'Portrait', 'Landscape'])[p_size % 11 + 1], CAST(p_size % 11 AS VARCHAR))},
 {'k': 'white_balance', 'v': CASE p_size % 3 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Manual' ELSE '2' END},
 {'k': 'date_taken', 'v': strftime(DATE '2015-01-01' + CAST(p_partkey % 3000 AS INTEGER), '%Y-%m-%d') || ' 10:11:12'}] AS f FROM part),
u AS (SELECT id, unnest(f) AS e FROM p) SELECT id, e.k AS key, e.v AS value FROM u WHERE e.v IS NOT NULL"""),
    "decode_documents": (decode_documents, "SELECT doc_id, md5(nfc_normalize(coalesce(text, ''))) AS digest, CASE doc_id % 3 WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'utf-8' ELSE 'utf-16' END AS encoding, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(65533), '')) AS replaced FROM documents"),
    "code_spans": (code_spans, """WITH f AS (SELECT s_suppkey AS id, CAST(s_acctbal AS VARCHAR) AS bal, s_name AS name, unnest(range(s_suppkey % 7 + 1)) AS i FROM supplier),
e AS (SELECT *, length('class S' || id || '_' || i || ':') AS head, length('    def area(self):' || '        return ' || bal || ' * ' || i) + 1 AS area, length('    def name(self):' || '        return "' || name || '"') + 1 AS tail FROM f)
SELECT id || '.py' AS path, 6 * i AS first, 6 * i + 6 AS until, 'class' AS kind, 'S' || id || '_' || i AS symbol, head + 1 + area + 2 + tail AS length FROM e
UNION ALL SELECT id || '.py', 6 * i + 1, 6 * i + 4, 'method', 'area', area + 1 FROM e UNION ALL SELECT id || '.py', 6 * i + 4, 6 * i + 6, 'method', 'name', tail FROM e"""),
    "document_spans": (document_spans, """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
r AS (SELECT doc_id, len(lines) AS n, lines, [k - 1 for k in range(1, len(lines) + 1) if trim(lines[k]) = '' OR regexp_matches(trim(lines[k]), '^(?:#|//)')] AS rests FROM l),
w AS (SELECT *, unnest(range(0, greatest(0, n - 21) + 1, 20)) AS first FROM r), e AS (SELECT *, least(first + 40, n) AS until FROM w),
c AS (SELECT *, list_max([b for b in rests if b < until]) AS rest FROM e), u AS (SELECT lines, first, CASE WHEN until < n AND rest >= first + 20 THEN rest + 1 ELSE until END AS until FROM c),
t AS (SELECT first, until, array_to_string(lines[first + 1:until], chr(10)) AS text FROM u)
SELECT 'window' AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(first) AS BIGINT) AS firsts, CAST(sum(until) AS BIGINT) AS untils
FROM t WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 50"""),
    "typescript_details": (typescript_details, f"SELECT * FROM {_values(_SYMBOLS)} v(kind, name, detail, implements)"),
    "commit_analysis": (commit_analysis, f"SELECT * FROM {_values(_ANALYSIS)} v(hash, path, old_path, change_type, additions, deletions, loc_after, requirements, sprints)"),
    "attempt_flags": (attempt_flags, "SELECT source, count(*) FILTER (regexp_matches(lower(text), 'wip|spike|attempt')) AS attempts, count(*) AS n FROM documents GROUP BY 1"),
    "chunk_links": (chunk_links, """WITH r AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'FR-' ELSE 'NFR-' END || lpad(CAST(s_suppkey % 40 AS VARCHAR), 2, '0') || '-' || s_suppkey AS id FROM supplier),
m AS (SELECT DISTINCT l_suppkey AS key, l_orderkey AS doc FROM lineitem WHERE l_returnflag = 'A')
SELECT 'CONTAINS_CHUNK' AS type, source AS src, CAST(doc_id AS VARCHAR) AS dst FROM documents WHERE source IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'PART_OF', id, CAST(doc AS VARCHAR) FROM r JOIN m ON m.key = r.key
UNION ALL SELECT 'PART_OF', id, CAST(n_nationkey AS VARCHAR) FROM r JOIN nation ON n_nationkey = CAST(regexp_extract(id, '^N?FR-([0-9]{2})', 1) AS INTEGER) WHERE key NOT IN (SELECT key FROM m)"""),
    "halved_batches": (halved_batches, None),
    "fulltext_labels": (fulltext_labels, """WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'File' AS label, p_name || ' ' || p_type AS text FROM part UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'Requirement', s_name FROM supplier
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'GitCommit', o_orderpriority FROM orders UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Chunk', text FROM documents),
w AS (SELECT id, label, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM x), h AS (SELECT id, label, count(DISTINCT t) AS matched, count(*) AS score FROM w WHERE t IN ('the', 'economy', 'urgent', 'red') GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY matched DESC, score DESC, label DESC) AS k FROM h) SELECT id, label, matched, score FROM b WHERE k = 1 ORDER BY matched DESC, score DESC, id LIMIT 200"""),
    "quality_database": (quality_database, f"""WITH {_FACTS}, v AS (SELECT *, commits + files + vectors + reqs + docs AS volume, missing / greatest(1, touched + impl) AS mr, orphans / greatest(1, nodes) AS orr FROM f)
SELECT 'volume' AS section, CAST(CASE WHEN volume >= 50000 THEN 35 WHEN volume >= 20000 THEN 32 WHEN volume >= 5000 THEN 28 WHEN volume >= 1000 THEN 24 WHEN volume >= 200 THEN 18 ELSE 12 END AS DOUBLE) AS score, 35 AS max_score FROM v
UNION ALL SELECT 'consistency', round(greatest(0, least(35, (1 - least(1, mr * 0.5::DOUBLE + orr * 2)) * 35)), 2), 35 FROM v
UNION ALL SELECT 'indexes', round(CAST(12 + (vectors > 0)::INT * 10 + ((commits > 0)::INT + (files > 0)::INT + (reqs > 0)::INT + (docs > 0)::INT + (vectors > 0)::INT) / 5.0::DOUBLE * 8 AS DOUBLE), 2), 30 FROM v"""),
    "quality_api": (quality_api, """WITH e AS (SELECT avg(CAST(value AS DOUBLE)) AS ms, count(*) FILTER (event_type = 'view') / count(*) AS hits, count(*) AS samples FROM events)
SELECT 'responsiveness' AS section, CAST(CASE WHEN ms <= 0 THEN 28 WHEN ms <= 80 THEN 40 WHEN ms <= 140 THEN 34 WHEN ms <= 220 THEN 28 WHEN ms <= 350 THEN 20 WHEN ms <= 500 THEN 14 ELSE 8 END AS DOUBLE) AS score, 40 AS max_score FROM e
UNION ALL SELECT 'caching', round(hits * 30, 2), 30 FROM e UNION ALL SELECT 'stability', round(CAST(least(1, samples / 180) * 18 + 12 AS DOUBLE), 2), 30 FROM e"""),
    "ann_search": (ann_search, None),
}
