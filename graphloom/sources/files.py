"""File sources: commit logs, repository walks, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def commit_log(lines: DataFrame) -> DataFrame:
    """Commits with their files from the lines (log, k, line) of `git log --name-status` with a tab-separated
    header of hash, author, e-mail, time and message: each following line with one tab (two for renames)
    belongs to the header above. Malformed lines are skipped. k numbers the lines of one log."""
    parts = F.split("line", "\t")
    header = (F.size(parts) >= 5) & F.element_at(parts, 1).rlike("^[0-9a-f]{7,40}$")
    rows = lines.select("log", "k", parts.alias("p"), header.alias("header"))
    above = F.last(F.when(F.col("header"), F.element_at("p", 1)), ignorenulls=True)
    rows = rows.withColumn("hash", above.over(Window.partitionBy("log").orderBy("k")))
    heads = rows.where("header").select("log", "hash", F.col("p")[1].alias("author"), F.col("p")[2].alias("email"), F.try_to_timestamp(F.col("p")[3]).alias("ts"), F.array_join(F.slice("p", F.lit(5), F.size("p")), "\t").alias("message"))
    kind = F.substring(F.col("p")[0], 1, 1)
    changes = rows.where("NOT header AND size(p) >= 2 AND hash IS NOT NULL AND p[0] RLIKE '^[AMDR][0-9]*$'").select(
        "log", "hash", kind.alias("change_type"), F.element_at("p", -1).alias("path"), F.when(kind == "R", F.try_element_at("p", F.lit(2))).alias("old_path")
    )
    return heads.join(changes, ["log", "hash"], "left")


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files of a folder, each read as a whole so that its line order is kept."""
    files = spark.read.format("binaryFile").load(path)
    return commit_log(files.select(F.col("path").alias("log"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("k", "line")))


def commit_records(records: DataFrame) -> DataFrame:
    """Commits with their files from records of `git log --name-status
    --format=%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%B%x1f` (column value): a record holds a commit whole, with a message of
    any number of lines, so no order between lines is needed. Records without a hash of 40 hex digits are
    skipped; a commit without files gives one row."""
    parts = F.split("value", "\x1f")
    rows = records.select(parts.alias("p")).where((F.size("p") >= 6) & F.trim(F.col("p")[0]).rlike("^[0-9a-f]{40}$"))
    change = F.filter(F.split(F.col("p")[5], "\n"), lambda x: x.rlike("^[AMDR][0-9]*\t.+"))
    body = F.regexp_replace(F.col("p")[4], r"^\s+|\s+$", "")
    rows = rows.select(
        F.trim(F.col("p")[0]).alias("hash"), F.col("p")[1].alias("author"), F.col("p")[2].alias("email"), F.try_to_timestamp(F.col("p")[3]).alias("ts"),
        body.alias("message"), F.split(body, "\n")[0].alias("subject"), F.explode_outer(change).alias("c"),
    )
    fields = F.split("c", "\t")
    kind = F.substring("c", 1, 1)
    return rows.select(
        "hash", "author", "email", "ts", "subject", "message", kind.alias("change_type"), F.element_at(fields, -1).alias("path"),
        F.when(kind == "R", F.get(fields, 1)).alias("old_path"),
    )


def read_commit_records(spark: SparkSession, path: str) -> DataFrame:
    """Log files of any size: they are split at record marks, so one log is read by many tasks."""
    return commit_records(spark.read.text(path, lineSep="\x1e"))


#: Folders that a walk leaves out and the largest file it reads.
EXCLUDED = [
    ".git", "__pycache__", "node_modules", "venv", ".venv", "env", "build", "dist", "target", ".mypy_cache", ".pytest_cache", ".cursor",
    ".vscode", ".idea",
]
LARGEST = 2 * 1024 * 1024


def walk(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with size, time and SHA-1, without excluded folders (in any case) and files over 2 MiB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("pathGlobFilter", pattern).load(path)
    kept = ~F.col("path").rlike("(?i)/(?:" + "|".join(x.replace(".", r"\.") for x in EXCLUDED) + ")/") & (F.col("length") <= LARGEST)
    return files.where(kept).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha1("content").alias("sha1"), "content")


def requirements(text: Column) -> Column:
    """Structs of library and constraint from the lines of a requirements file."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike("^[A-Za-z0-9]"))
    return F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^\s*([A-Za-z0-9_.\-]+)", 1)).alias("library"), F.trim(F.regexp_replace(x, r"^\s*[A-Za-z0-9_.\-]+", "")).alias("constraint")))


def package_sections(text: Column) -> Column:
    """Structs of section, library and version from a package manifest."""
    sections = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    maps = F.from_json(text, ", ".join(f"{s} map<string,string>" for s in sections))
    empty = F.from_json(F.lit("{}"), "map<string,string>")

    def rows(section: str) -> Column:
        return F.transform(
            F.map_entries(F.coalesce(maps[section], empty)),
            lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("library"), e["value"].alias("version")),
        )

    per = [rows(section) for section in sections]
    return F.concat(*per)


def requirement_rows(text: Column) -> Column:
    """Structs of id, description, priority from the table lines of a markdown text (four columns or more)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\|.*\b(?:FR|NFR)-\d{2}-\d{2}\b") & (F.size(F.split(x, r"\|")) >= 6))
    cell = lambda x, k: F.trim(F.split(x, r"\|")[k])
    return F.transform(lines, lambda x: F.struct(cell(x, 1).alias("id"), cell(x, 2).alias("description"), cell(x, 3).alias("priority")))


def releases(text: Column) -> Column:
    """Structs of version and date from `[x.y.z] - date` lines."""
    rule = r"\[(\d+\.\d+\.\d+)\] - (\d{4}-\d{2}-\d{2})"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(rule), 1).alias("version"), F.regexp_extract_all(text, F.lit(rule), 2).alias("date"))


def title(text: Column, stem: Column) -> Column:
    """The first level-one heading, else the first level-two heading, else the file's stem in title case."""
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(found(r"(?m)^# (.+)$"), found(r"(?m)^## (.+)$"), F.initcap(F.regexp_replace(stem, "[-_]+", " ")))


def sprint_status(text: Column) -> Column:
    """Structs of number, name, start and end from sections `## Sprint N: name` with a line
    `Dates: start to end`."""
    rule = r"(?m)^## Sprint (\d+): ([^\n]+)\n+Dates: (\d{4}-\d{2}-\d{2}) to (\d{4}-\d{2}-\d{2})"
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(rule), k).alias(n) for k, n in enumerate(("number", "name", "start", "end"), 1)])


def bullets(text: Column, word: str = "goal") -> Column:
    """The bullet lines of a text that mention a word, without their marks."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[-*] ") & F.lower(x).contains(word))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*] ", "")))


# Image metadata keys by their short names, and orientation codes.
EXIF_NAMES = {"FNumber": "aperture", "FocalLength": "focal_length", "ISOSpeedRatings": "iso", "Make": "camera_make", "Model": "camera_model", "Orientation": "orientation", "Keywords": "keywords"}
ORIENTATIONS = {"1": "normal", "3": "rotated 180", "6": "rotated 90 cw", "8": "rotated 90 ccw"}


def image_metadata(raw: Column) -> Column:
    """Raw metadata (map of strings) renamed and formatted: `f/2.8`, `50mm`, orientation labels, lists joined
    by `; `. Unknown keys are left out."""
    names = F.create_map(*[F.lit(x) for pair in EXIF_NAMES.items() for x in pair])
    labels = F.create_map(*[F.lit(x) for pair in ORIENTATIONS.items() for x in pair])

    def shown(k: Column, v: Column) -> Column:
        return (
            F.when(k == "FNumber", F.concat(F.lit("f/"), F.format_string("%.1f", v.cast("double"))))
            .when(k == "FocalLength", F.concat(v.cast("double").cast("int").cast("string"), F.lit("mm")))
            .when(k == "Orientation", F.coalesce(F.try_element_at(labels, v), v))
            .when(k == "Keywords", F.array_join(F.split(v, r"\s*,\s*"), "; "))
            .otherwise(F.trim(v))
        )

    kept = F.map_filter(raw, lambda k, v: F.map_contains_key(names, k) & v.isNotNull())
    return F.transform_keys(F.transform_values(kept, shown), lambda k, v: F.element_at(names, k))


def import_edges(modules: DataFrame, files: DataFrame) -> DataFrame:
    """File-to-file imports: (path, module) against the module names of files (path): a package's file or
    its __init__; the module itself first, else its parent (an imported name). One equi-join on a module
    index, ranked by how much of the name matched."""
    stem = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", "")
    index = files.select(F.col("path").alias("dst"), F.replace(stem, F.lit("/"), F.lit(".")).alias("name"))
    parts = F.split("module", r"\.")
    asked = modules.select("path", "module", F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).where((F.col("up") == 0) | (F.size(parts) > 1))
    asked = asked.withColumn("name", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - F.col("up")), "."))
    hits = asked.join(index, "name").where(F.col("dst") != F.col("path"))
    best = hits.groupBy("path", "module").agg(F.min(F.struct("up", "dst"))["dst"].alias("dst"))
    return best.groupBy(F.col("path").alias("src"), "dst").agg(F.count(F.lit(1)).alias("weight"))
