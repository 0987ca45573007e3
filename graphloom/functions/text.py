"""Chunking and parsing of documents and source files as table functions."""

from __future__ import annotations

import ast
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scalars import slugify


def markdown_chunks(docs: DataFrame, levels: str = "{2,3}", least: int = 50) -> DataFrame:
    """Sections of markdown (path, text): a heading of the given levels starts one; sections with fewer
    than `least` characters are dropped, not merged. Gives path, n, heading, chunk and the chunk's id."""
    rows = docs.select("path", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    starts = F.col("line").rlike(f"^#{levels} ")
    w = Window.partitionBy("path").orderBy("k")
    rows = rows.withColumn("section", F.sum(starts.cast("int")).over(w))
    parts = rows.groupBy("path", "section").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("chunk"),
        F.min_by(F.when(starts, F.regexp_replace("line", "^#+ ", "")), "k").alias("heading"),
    )
    kept = parts.withColumn("chunk", F.regexp_replace("chunk", r"^\s+|\s+$", "")).where(F.length("chunk") >= least)
    n = F.row_number().over(Window.partitionBy("path").orderBy("section"))
    return kept.select("path", n.alias("n"), "heading", "chunk").withColumn("id", F.concat_ws("#", "path", "n"))


def slug_chunks(docs: DataFrame, most: int = 4000) -> DataFrame:
    """Sections by headings of level 1 to 3 with ids path#slug-NN, NN counting within the level."""
    rows = docs.select("path", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    is_head = F.col("line").rlike("^#{1,3} ")
    rows = rows.withColumn("section", F.sum(is_head.cast("int")).over(Window.partitionBy("path").orderBy("k"))).where("section > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    parts = rows.groupBy("path", "section").agg(F.min_by("line", "k").alias("line"), F.substring(body, 1, most).alias("text"))
    parts = parts.withColumn("level", F.length(F.regexp_extract("line", "^(#+)", 1)))
    return parts.withColumn("nn", F.row_number().over(Window.partitionBy("path", "level").orderBy("section"))).select(
        F.concat(F.col("path"), F.lit("#"), slugify(F.regexp_replace("line", "^#+ ", "")), F.lit("-"), F.lpad(F.col("nn").cast("string"), 2, "0")).alias("id"), "level", "text"
    )


def paragraph_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraphs by blank lines, trimmed; blank ones are dropped."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n\n+")).alias("n", "chunk"))
    return rows.where(F.length(F.trim("chunk")) > 0).select(key, "n", F.trim("chunk").alias("chunk"))


def whole_chunks(docs: DataFrame, key: str, text: str, most: int = 10_000) -> DataFrame:
    """One chunk a text, for files that are not split: its first `most` characters and its full length."""
    return docs.where(F.length(text) > 0).select(key, F.substring(text, 1, most).alias("chunk"), F.length(text).alias("length"))


def sliding_chunks(docs: DataFrame, key: str, text: str, size: int = 40, overlap: int = 20) -> DataFrame:
    """Windows of `size` lines that overlap; the last may be shorter, a shorter text gives one window."""
    lines = F.split(text, "\n")
    rows = docs.select(key, lines.alias("lines")).withColumn("from", F.explode(F.sequence(F.lit(0), F.greatest(F.size("lines") - overlap - 1, F.lit(0)), F.lit(size - overlap))))
    part = F.slice("lines", F.col("from") + 1, size)
    return rows.select(key, "from", F.size(part).alias("n_lines"), F.array_join(part, "\n").alias("chunk"))


def python_symbols(files: DataFrame) -> DataFrame:
    """path, symbol_id, name, kind, line, signature of classes, functions and methods of Python files
    (path, source); a file that cannot be parsed gives none. Arrow batches; parsing is a per-file helper."""

    def symbols(path: str, source: str | None):
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError):
            return
        stack = [(tree, "")]
        while stack:
            node, owner = stack.pop()
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if owner else "function"
                    name = f"{owner}.{child.name}" if owner else child.name
                    args = [] if kind == "class" else [a.arg for a in child.args.args]
                    yield path, f"{path}::{kind}::{name}", child.name, kind, child.lineno, f"{child.name}({', '.join(args)})"
                    stack.append((child, name if kind == "class" else owner))

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [s for p, t in zip(frame["path"], frame["source"]) for s in symbols(p, t)]
            yield pd.DataFrame(rows, columns=["path", "symbol_id", "name", "kind", "line", "signature"])

    return files.select("path", "source").mapInPandas(run, "path string, symbol_id string, name string, kind string, line int, signature string")


#: How functions and types of TypeScript start.
TS_SYMBOLS = r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(class|interface|function)\s+([A-Za-z_$][\w$]*)"
CODE_STARTS = r"^(?:def |class |async def |function |export |const \w+ = )"


def ts_symbols(source: Column) -> Column:
    """Structs of kind and name."""
    kinds, names = F.regexp_extract_all(source, F.lit(TS_SYMBOLS), 1), F.regexp_extract_all(source, F.lit(TS_SYMBOLS), 2)
    return F.arrays_zip(kinds.alias("kind"), names.alias("name"))


def code_chunks(files: DataFrame) -> DataFrame:
    """Chunks that start at lines that open a definition; what stands before the first is chunk 0."""
    rows = files.select("path", F.posexplode(F.split("source", "\n")).alias("k", "line"))
    w = Window.partitionBy("path").orderBy("k")
    rows = rows.withColumn("part", F.sum(F.col("line").rlike(CODE_STARTS).cast("int")).over(w))
    return rows.groupBy("path", "part").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.min_by("line", "k").alias("opening"))


def imports(source: Column) -> Column:
    """Module names that a Python source imports."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z_][\w.]*)"), 1))


def parse_photo_query(text: Column) -> dict[str, Column]:
    """The parts of a free-text photo query."""
    grab = lambda p, g=1: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    return {
        "year": grab(r"\b((?:19|20)\d{2})\b").cast("int"),
        "aperture": grab(r"(?i)\bf/(\d+(?:\.\d+)?)").cast("double"),
        "focal": grab(r"(?i)\b(\d{1,4})mm\b").cast("int"),
        "iso": grab(r"(?i)\biso\s?(\d{2,6})\b").cast("int"),
        "shutter": grab(r"\b(1/\d{1,5})s?\b"),
        "brand": F.lower(grab(r"(?i)\b(canon|nikon|sony|fujifilm|olympus|panasonic|leica)\b")),
        "tags": F.array_join(F.regexp_extract_all(text, F.lit(r"#(\w+)"), 1), ","),
        "rest": F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)#\w+|\bf/\d+(?:\.\d+)?|\b\d{1,4}mm\b|\biso\s?\d{2,6}\b|\b1/\d{1,5}s?\b|\b(?:19|20)\d{2}\b|\b(?:canon|nikon|sony|fujifilm|olympus|panasonic|leica)\b", " "), " +", " ")),
    }


def decode_bytes(content: Column) -> Column:
    """Text of file bytes: UTF-8 with or without a mark, else Latin-1; with the encoding and the number of
    replacement characters. Native functions only."""
    bom = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    body = F.when(bom, F.substring(content, 4, 2147483647)).otherwise(content)
    text = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(F.decode(body, "ISO-8859-1"))
    name = F.when(bom, "utf-8-sig").when(F.is_valid_utf8(body.cast("string")), "utf-8").otherwise("latin-1")
    return F.struct(text.alias("text"), name.alias("encoding"), (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))).alias("replaced"))



DECODED = "text string, encoding string, replaced int"


def decode_any(content: Column) -> Column:
    """Text of file bytes, composed (NFC), with the encoding and the number of replacement characters. UTF-8 with
    or without a mark and UTF-16 with a mark are read as such; else the single-byte page under which most
    characters are letters or spaces wins, Windows-1252 before the others; null bytes give null."""

    return F.pandas_udf(_decoded, DECODED)(content)


def _decoded(contents: pd.Series) -> pd.DataFrame:
    def read(raw: bytes | None) -> tuple:
        if raw is None:
            return None, None, None
        marked = "utf-8-sig" if raw.startswith(b"\xef\xbb\xbf") else "utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else None
        for name in [marked] if marked else ["utf-8"]:
            try:
                return normalize("NFC", text := raw.decode(name)), name, text.count("\ufffd")
            except UnicodeDecodeError:
                pass
        plain = lambda text: sum(c.isalpha() or c.isspace() for c in text) - 9 * text.count("\ufffd")
        name = max(("cp1252", "latin-1", "cp1251", "iso8859-2"), key=lambda n: plain(raw.decode(n, "replace")))
        text = raw.decode(name, "replace")
        return normalize("NFC", text), name, text.count("\ufffd")

    return pd.DataFrame([read(x) for x in contents], columns=["text", "encoding", "replaced"])
