"""Chunking, parsing and text search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import bind
from graphloom.functions import scalars
from graphloom.functions import text as tx
from graphloom.operators import inverted
from graphloom.plans.derive import _frame, _values
from graphloom.session import table
from graphloom.sources import files as src


def chunk_paragraphs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return tx.paragraph_chunks(docs, "doc_id", "text").select("doc_id", F.col("n").cast("long").alias("n"), F.length("chunk").cast("long").alias("length"))


def chunk_sliding(spark, d):
    rows = tx.sliding_chunks(table(spark, d, "documents"), "doc_id", "text", 4, 2)
    return rows.select("doc_id", F.col("from").cast("long").alias("from_line"), F.col("n_lines").cast("long").alias("n_lines"), F.md5("chunk").alias("digest"))


def loc_after(spark, d):
    lines = F.size(F.split("text", "\n"))
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(lines).alias("loc"), F.max(lines).cast("long").alias("longest"))


def manifest_snapshot(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha1("text").alias("sha1"))


def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.slugify(F.col("text")).alias("slug"))


def redact_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(scalars.redact_tokens(F.col("text"))).alias("digest"))


def escape_query(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.escape_query(F.concat("p_brand", F.lit(" (a+b) [c]: "), "p_name")).alias("q"))


def top_keywords(spark, d):
    """The five most frequent words of four letters or more for each source."""
    words = table(spark, d, "documents").select("source", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("length(w) >= 4")
    counts = words.groupBy("source", "w").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "w")
    return counts.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("source", "w", "n")


def fulltext_search(spark, d):
    """The documents with most of some words, read from the kept index."""
    hits = inverted.matches(bind.search_index(spark, d), ["the", "thes", "inea", "anha"]).where("label = 'Chunk'")
    return hits.select(F.col("id").cast("long").alias("doc_id"), "matched", F.col("hits").alias("score")).orderBy(F.desc("matched"), F.desc("score"), "doc_id").limit(20)


def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


EXIF = [(1, {"FNumber": "2.8", "FocalLength": "50.0", "Orientation": "6", "Keywords": "a , b", "Other": "x"}), (2, {"Make": " Canon ", "Model": None}), (3, None)]


def image_metadata(spark, d):
    rows = _frame(spark, EXIF, "id int, raw map<string,string>")
    return rows.select("id", F.explode(src.image_metadata(F.col("raw"))).alias("key", "value"))


def get_by_id(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").isin(3, 17, 10**12)).select("doc_id", "lang", "source", F.md5("text").alias("digest"))


def curation_status(spark, d):
    """Each document's status: archived if it is an exact copy of an earlier one, rejected by label, else kept."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("keep"))
    labels = table(spark, d, "labels").select("doc_id", "quality")
    status = F.when(F.col("doc_id") != F.col("keep"), "archived").when(F.col("quality") == 0, "rejected").otherwise("kept")
    return docs.join(first, "sha").join(labels, "doc_id", "left").select("doc_id", status.alias("status"))


def decode_files(spark, d):
    rows = _frame(spark, [(1, b"\xef\xbb\xbfabc"), (2, "grün".encode()), (3, "grün".encode("latin-1")), (4, b"")], "id int, content binary")
    return rows.select("id", tx.decode_bytes(F.col("content")).alias("t")).select("id", "t.text", "t.encoding", F.col("t.replaced").alias("replaced"))


_ESC = r"""regexp_replace(p_brand || ' (a+b) [c]: ' || p_name, '([+\-!(){}\[\]^"~*?:\\/&|])', '\\\1', 'g')"""
_SLUG = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 -]', '', 'g'), '[ -]+', '-', 'g'), '-')"
QUERIES = {
    "chunk_paragraphs": (chunk_paragraphs, "WITH s AS (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+') AS p FROM documents), x AS (SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS n, trim(unnest(p)) AS c FROM s) SELECT doc_id, n, length(c) AS length FROM x WHERE length(c) > 0"),
    "chunk_sliding": (chunk_sliding, "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, l, unnest(generate_series(0, greatest(len(l) - 3, 0), 2)) AS f FROM s) SELECT doc_id, f AS from_line, len(l[f + 1:f + 4]) AS n_lines, md5(array_to_string(l[f + 1:f + 4], chr(10))) AS digest FROM x"),
    "loc_after": (loc_after, "SELECT lang, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS loc, max(len(string_split(text, chr(10)))) AS longest FROM documents GROUP BY 1"),
    "manifest_snapshot": (manifest_snapshot, "SELECT doc_id, strlen(text) AS size, sha1(text) AS sha1 FROM documents"),
    "slugify": (slugify, f"SELECT doc_id, {_SLUG} AS slug FROM documents"),
    "redact_tokens": (redact_tokens, "SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9]{32,}', '<redacted>', 'g')) AS digest FROM documents"),
    "escape_query": (escape_query, f"SELECT p_partkey, {_ESC} AS q FROM part"),
    "top_keywords": (top_keywords, "WITH w AS (SELECT source, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM documents), c AS (SELECT source, w, count(*) AS n FROM w WHERE length(w) >= 4 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS k FROM c) SELECT source, w, n FROM r WHERE k <= 5"),
    "fulltext_search": (fulltext_search, "WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM documents) SELECT doc_id, count(DISTINCT t) AS matched, count(*) AS score FROM w WHERE t IN ('the', 'thes', 'inea', 'anha') GROUP BY 1 ORDER BY matched DESC, score DESC, doc_id LIMIT 20"),
    "page_titles": (page_titles, "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages"),
    "image_metadata": (image_metadata, "SELECT * FROM (VALUES (1, 'aperture', 'f/2.8'), (1, 'focal_length', '50mm'), (1, 'orientation', 'rotated 90 cw'), (1, 'keywords', 'a; b'), (2, 'camera_make', 'Canon')) v(id, key, value)"),
    "get_by_id": (get_by_id, "SELECT doc_id, lang, source, md5(text) AS digest FROM documents WHERE doc_id IN (3, 17, 1000000000000)"),
    "curation_status": (curation_status, "SELECT d.doc_id, CASE WHEN d.doc_id <> min(d.doc_id) OVER (PARTITION BY sha256(text)) THEN 'archived' WHEN quality = 0 THEN 'rejected' ELSE 'kept' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "decode_files": (decode_files, f"SELECT * FROM {_values([(1, 'abc', 'utf-8-sig', 0), (2, 'grün', 'utf-8', 0), (3, 'grün', 'latin-1', 0), (4, '', 'utf-8', 0)])} v(id, text, encoding, replaced)"),
}
