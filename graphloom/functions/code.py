"""Source code and diffs: spans of definitions, TypeScript symbols, commit analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How definitions start, by language, and the languages of extensions.
STARTS = {
    "python": {"function": r"^def\s+(\w+)\s*\(", "class": r"^class\s+(\w+)", "method": r"^\s+def\s+(\w+)\s*\("},
    "braces": {
        "function": r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", "class": r"^(?:export\s+)?class\s+(\w+)",
        "method": r"^\s*(?:public\s+|private\s+|protected\s+)?(?:async\s+)?(?!(?:if|for|while|switch|catch|return|function)\b)(\w+)\s*\([^)]*\)[^;{]*\{",
    },
}
LANGUAGES = {".py": "python", ".ts": "braces", ".tsx": "braces", ".js": "braces", ".jsx": "braces"}


def line_table(files: DataFrame) -> DataFrame:
    """path, source -> one row a line: path, k (from 0), n (lines of the file), line, language, and kind and
    symbol where a definition starts. Null paths and sources give none."""
    suffix = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    language = F.coalesce(*[F.when(suffix == ending, name) for ending, name in LANGUAGES.items()])
    split = F.split("source", "\n")
    lines = files.where("path IS NOT NULL AND source IS NOT NULL").select("path", language.alias("language"), F.size(split).alias("n"), F.posexplode(split).alias("k", "line"))
    kinds = [(name, kind, pattern) for name, found in STARTS.items() for kind, pattern in found.items()]
    starts = lambda name, pattern: (F.col("language") == name) & F.col("line").rlike(pattern)
    kind = F.coalesce(*[F.when(starts(name, pattern), kind) for name, kind, pattern in kinds])
    symbol = F.coalesce(*[F.when(starts(name, pattern), F.regexp_extract("line", pattern, 1)) for name, kind, pattern in kinds])
    return lines.withColumn("kind", kind).withColumn("symbol", symbol)


def definitions(lines: DataFrame) -> DataFrame:
    """path, first, until, kind, symbol of every definition of a line table.

    A line has a level: its indentation (Python; blank lines have none), or the depth of braces after it, a
    running sum. A definition ends at the first line, from where its body may end on, that is back at its
    own level: the next line that is indented no deeper, or the line that closes the first brace opened
    since; else with the file. For each level at which definitions stand, the nearest such line at or after
    any line is a running minimum from the end of the file.
    """
    by_line = Window.partitionBy("path").orderBy("k")
    python = F.col("language") == "python"
    blank, indent = F.trim("line") == "", F.length(F.regexp_extract("line", r"^(\s*)", 1))
    opened, closed = F.regexp_count("line", F.lit(r"\{")), F.regexp_count("line", F.lit(r"\}"))
    depth = F.sum(opened - closed).over(by_line)
    opens = F.min(F.when(opened > 0, F.col("k"))).over(by_line.rowsBetween(0, Window.unboundedFollowing))
    levelled = lines.where("language IS NOT NULL").select(
        "path", "k", "n", "language", "kind", "symbol",
        F.when(python, F.when(~blank, indent)).otherwise(depth).alias("level"),
        F.when(python, indent).otherwise(depth - opened + closed).alias("base"),
        F.when(python, F.col("k") + 1).otherwise(opens).alias("from"),
    )
    starts = levelled.where("kind IS NOT NULL")
    grid = levelled.select("path", "k", "level").join(starts.select("path", "base").distinct(), "path")
    onward = Window.partitionBy("path", "base").orderBy(F.desc("k"))
    back = grid.select("path", "base", F.col("k").alias("from"), F.min(F.when(F.col("level") <= F.col("base"), F.col("k"))).over(onward).alias("at"))
    until = F.coalesce(F.col("at") + F.when(python, 0).otherwise(1), F.col("n"))
    return starts.drop("level").join(back, ["path", "base", "from"], "left").select("path", F.col("k").alias("first"), until.alias("until"), "kind", "symbol")


def windows(lines: DataFrame, spans: DataFrame, window: int, overlap: int) -> DataFrame:
    """path, first, until of windows over the gaps between spans: one every window - overlap lines, each
    ending after the last blank or comment line among its last `overlap` lines if it has one there and the
    gap goes on."""
    edges = spans.select("path", F.col("first").alias("k"), F.lit(1).alias("e")).unionAll(spans.select("path", F.col("until").alias("k"), F.lit(-1).alias("e")))
    edges = edges.groupBy("path", "k").agg(F.sum("e").alias("e"))
    by_line = Window.partitionBy("path").orderBy("k")
    covered = F.sum(F.coalesce("e", F.lit(0))).over(by_line) > 0
    rests = (F.trim("line") == "") | F.trim("line").rlike("^(?:#|//)")
    marked = lines.join(edges, ["path", "k"], "left").select("path", "k", covered.alias("covered"), F.max(F.when(rests, F.col("k"))).over(by_line).alias("rest"))
    gap = F.sum(F.when(F.col("covered"), 1).otherwise(0)).over(by_line)
    free = marked.withColumn("gap", gap).where("NOT covered")
    gaps = free.groupBy("path", "gap").agg(F.min("k").alias("low"), (F.max("k") + 1).alias("high"))
    step = window - overlap
    # A window starts only where the one before has not reached the end of the gap.
    last = F.greatest(F.col("low"), F.col("high") - 1 - overlap)
    dealt = gaps.select("path", "high", F.explode(F.sequence(F.col("low"), last, F.lit(step))).alias("first"))
    dealt = dealt.withColumn("end", F.least(F.col("first") + window, "high"))
    nearest = free.select("path", (F.col("k") + 1).alias("end"), "rest")
    rested = (F.col("end") < F.col("high")) & (F.col("rest") >= F.col("first") + step)
    return dealt.join(nearest, ["path", "end"]).select("path", "first", F.when(rested, F.col("rest") + 1).otherwise(F.col("end")).alias("until"))


def code_spans(files: DataFrame, least: int = 50, window: int = 40, overlap: int = 20) -> DataFrame:
    """path, first, until, kind, symbol, text of the chunks of source files (path, source; a path once):
    definitions with their ends found by indentation (Python) or braces (TypeScript, JavaScript), and windows
    for the rest. Texts under `least` characters are left out, and what such definitions cover goes to the
    windows. A null source gives none, other endings have windows alone."""
    lines = line_table(files)
    sources = files.where("path IS NOT NULL AND source IS NOT NULL").select("path", F.split("source", "\n").alias("lines"))
    text = F.array_join(F.slice("lines", F.col("first") + 1, F.col("until") - F.col("first")), "\n")
    defined = definitions(lines).join(sources, "path").withColumn("text", text).drop("lines").where(F.length("text") >= least)
    rest = windows(lines, defined.select("path", "first", "until"), window, overlap).join(sources, "path").withColumn("text", text).drop("lines")
    rest = rest.where(F.length(F.trim("text", F.lit(" \t\n\x0b\f\r"))) >= least).select("path", "first", "until", F.lit("window").alias("kind"), F.lit(None).cast("string").alias("symbol"), "text")
    return defined.select(*rest.columns).unionAll(rest)


# How symbols of TypeScript are written.
_TS = {
    "class": r"\bclass\s+([A-Za-z_]\w*)\s*(?:extends\s+([^{\s]+))?\s*(?:implements\s+([^{]+))?\s*\{",
    "interface": r"\binterface\s+([A-Za-z_]\w*)\s*(?:extends\s+([^{]+))?()\s*\{",
    "function": r"\bfunction\s+([A-Za-z_]\w*)\s*(\([^)]*\))()",
    "arrow": r"\bconst\s+([A-Za-z_]\w*)\s*=\s*(?:async\s+)?(\([^)]*\)|[A-Za-z_]\w*)()\s*=>",
    "method": r"(?m)^[ \t]+(?:(?:public|private|protected|static|async)\s+)*(?!(?:if|for|while|switch|catch|return|function|constructor)\b)([A-Za-z_]\w*)\s*(\([^)]*\))()\s*(?::\s*[^{;=]+)?\{",
}


def typescript_symbols(source: Column) -> Column:
    """Structs of kind, name, detail (what it extends, or its parameters) and implements."""
    def found(kind: str, pattern: str) -> Column:
        part = lambda g: F.regexp_extract_all(source, F.lit(pattern), g)
        clean = lambda c: F.nullif(F.trim(c), F.lit(""))
        zipped = F.arrays_zip(part(1).alias("n"), part(2).alias("d"), part(3).alias("i"))
        return F.transform(zipped, lambda s: F.struct(F.lit(kind).alias("kind"), s["n"].alias("name"), clean(s["d"]).alias("detail"), clean(s["i"]).alias("implements")))

    return F.concat(*[found(k, p) for k, p in _TS.items()])


# Ids of requirements and sprints in commits.
REQUIREMENT, SPRINT = r"\b(?:FR|NFR)-\d{2}-\d{2}\b", r"\b(?:sprint|Sprint)-(\d+)\b"


def change_analysis(changes: DataFrame) -> DataFrame:
    """One row a changed file from (hash, message, path, old_path, is_new, is_deleted, is_renamed, diff,
    content): its type, added and removed lines, lines after the commit, and the ids of requirements and
    sprints in message, path and (of code files) content."""
    ids = lambda text: F.coalesce(F.regexp_extract_all(text, F.lit(f"({REQUIREMENT})"), 1), F.array().cast("array<string>"))
    sprints = lambda text: F.coalesce(F.regexp_extract_all(text, F.lit(SPRINT), 1), F.array().cast("array<string>"))
    code = F.when(F.col("path").rlike(r"(?i)\.(?:py|ts|tsx|js|jsx)$"), F.col("content"))
    breaks = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    marks = lambda m: F.coalesce(F.regexp_count("diff", F.lit(rf"\n\{m}")), F.lit(0))
    return changes.select(
        "hash", "path", F.when(F.col("is_renamed"), F.col("old_path")).alias("old_path"),
        F.when(F.col("is_new"), "A").when(F.col("is_deleted"), "D").when(F.col("is_renamed"), "R").otherwise("M").alias("change_type"),
        marks("+").alias("additions"), marks("-").alias("deletions"),
        F.when(F.col("is_deleted") | (F.coalesce(F.length("content"), F.lit(0)) == 0), 0).otherwise(breaks + F.when(F.col("content").endswith("\n"), 0).otherwise(1)).alias("loc_after"),
        F.sort_array(F.array_distinct(F.concat(ids(F.col("message")), ids(F.col("path")), ids(code)))).alias("requirements"),
        F.sort_array(F.array_distinct(F.concat(sprints(F.col("message")), sprints(F.col("path")), sprints(code)))).alias("sprints"),
    )


def is_attempt(message: Column) -> Column:
    """Whether a commit message speaks of work in progress, a spike or an attempt."""
    return F.coalesce(F.lower(message).rlike("wip|spike|attempt"), F.lit(False))
