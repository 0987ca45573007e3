"""The parsers on small texts with known results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import photos, scalars
from graphloom.functions import text as tx
from graphloom.operators import evidence as ev
from graphloom.plans.derive import _frame, _values
from graphloom.sources import files as src
from tests.test_oracles import rows_of

MARKDOWN = "# Top\nintro\n## Setup\nInstall the package with the usual tool and run the first job.\n### Notes\nshort\n## Usage: run it!\nCall run with a session and a path; the result is a table of rows.\n"
LOG = [
    ("a", 0, "1111111aaa\tAnn\ta@x.org\t2024-01-02T03:04:05\tAdd core\twith tab"), ("a", 1, "A\tsrc/core.py"), ("a", 2, "M\tREADME.md"), ("a", 3, "broken line"),
    ("a", 4, "2222222bbb\tBob\tb@x.org\t2024-01-03T00:00:00\tRename"), ("a", 5, "R100\tsrc/core.py\tsrc/main.py"), ("a", 6, ""), ("a", 7, "3333333ccc\tCy\tc@x.org\tbad time\tEmpty"),
]
SOURCE = "import os\nfrom app.core import run\n\nclass A:\n    def go(self, x):\n        return x\n\ndef main():\n    return A()\n"
STATUS = "# Sprints\n\n## Sprint 1: Start\n\nDates: 2024-01-01 to 2024-01-14\n- Goal: ship it\n* other\n## Sprint 2: Next one\nDates: 2024-01-15 to 2024-01-28\n  - second goal\n"
TS = "export class Page {}\ninterface Props { a: string }\nexport default function render(p) {}\nconst x = 1\nasync function load() {}\n"
PHOTOS = [(1, "happy family 2017 strasbourg canon #vacation f/2.8 50mm iso100 1/200s"), (2, "sunset"), (3, None)]
IMPORTS = [("app/main.py", "app.core.util"), ("app/main.py", "app.core.util.run"), ("app/main.py", "os"), ("app/core/util.py", "app.core"), ("app/core/util.py", "app.core.util")]
MODULES = ["app/main.py", "app/core/__init__.py", "app/core/util.py"]
FILES = ["app/core/main.py", "app/core/util.py", "lib/util.py", "app/README.md", "app/web/page.tsx"]
CHUNK_TERMS = [(1, "app/core/main.py"), (1, "core/util.py"), (2, "README.md"), (2, "util.py"), (3, "web/page.tsx"), (3, "page.tsx"), (4, "none.py")]
ALIASES = [("sklearn", "scikit-learn"), ("PIL", "pillow"), ("cv2", "opencv-python"), ("yaml", "pyyaml")]
USES = [("a.py", "sklearn"), ("a.py", "numpy"), ("b.py", "PIL"), ("c.py", "yaml"), ("c.py", "react-dom")]
DIFFS = [(1, "requirements.txt", "+numpy==1.2\n-pandas>=1\n context"), (2, "package.json", '+    "react": "^18",\n-    "vue": "3"'), (3, "wip: try\n", "+x")]
CHANGES = [("a.py", "A", None), ("", "X", None), ("b.py", "R", "c.py"), ("d.py", "R", None), (None, "M", None)]
QUERIES_OF_PHOTOS = [
    (1, "happy family 2017 strasbourg canon #vacation f/2.8 50mm iso100 1/200s"), (2, "Portrait May 2020 sigma tag:Kids kw:beach city=Paris f1.4 2s"),
    (3, "sunset iso: 800 camera_make:Nikon"), (4, "sunset"), (5, ""), (6, None),
]
_PHOTOS = [
    (1, "2017", None, "canon", "canon", "f/2.8", "50mm", "100", "1/200s", "vacation", None, None, "happy family strasbourg"),
    (2, "2020", "may", "sigma", "sigma", "f/1.4", None, None, "2s", "kids", "beach", "city=paris", "Portrait"),
    (3, None, None, "nikon", "nikon", None, None, None, None, None, None, "iso=800,camera_make=nikon", "sunset camera_make:"),
    (4, None, None, None, None, None, None, None, None, None, None, None, "sunset"), (5, *[None] * 11, ""), (6, *[None] * 12),
]


def parse_requirements(spark, d):
    rows = _frame(spark, [("numpy==1.2\n# note\nFastAPI >= 0.1\n\npandas",)], "t string")
    return rows.select(F.explode(src.requirements(F.col("t"))).alias("r")).select("r.*")


def parse_package(spark, d):
    rows = _frame(spark, [('{"dependencies": {"react": "^18"}, "devDependencies": {"vite": "5"}}',)], "t string")
    return rows.select(F.explode(src.package_sections(F.col("t"))).alias("r")).select("r.*")


def parse_requirement_table(spark, d):
    text = "| ID | Text | Prio | Criteria |\n|---|---|---|---|\n| FR-10-01 | Login works | high | test |\n| x | y |\n| NFR-02-03 | Fast | low | bench |"
    return _frame(spark, [(text,)], "t string").select(F.explode(src.requirement_rows(F.col("t"))).alias("r")).select("r.*")


def parse_releases(spark, d):
    rows = _frame(spark, [("# Log\n## [1.2.0] - 2024-05-01\n- x\n## [1.1.9] - 2024-04-01",)], "t string")
    return rows.select(F.explode(src.releases(F.col("t"))).alias("r")).select("r.*")


def parse_sprints(spark, d):
    return _frame(spark, [(STATUS,)], "t string").select(F.explode(src.sprint_status(F.col("t"))).alias("s")).select("s.*")


def parse_bullets(spark, d):
    return _frame(spark, [(STATUS,)], "t string").select(F.explode(src.bullets(F.col("t"))).alias("bullet"))


def document_titles(spark, d):
    rows = _frame(spark, [("## Second\n# First", "a-b"), ("## Only\ntext", "c"), ("plain", "read_me-now")], "t string, stem string")
    return rows.select("stem", src.title(F.col("t"), F.col("stem")).alias("title"))


def chunk_markdown(spark, d):
    return tx.markdown_chunks(_frame(spark, [("a.md", MARKDOWN)], "path string, text string")).select("id", "heading", F.length("chunk").alias("length"))


def chunk_slugs(spark, d):
    return tx.slug_chunks(_frame(spark, [("a.md", MARKDOWN)], "path string, text string")).select("id", "level")


def code_symbols(spark, d):
    return tx.python_symbols(_frame(spark, [("a.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, source string"))


def code_imports(spark, d):
    return _frame(spark, [(SOURCE,)], "source string").select(F.explode(tx.imports(F.col("source"))).alias("module"))


def commit_log(spark, d):
    rows = src.commit_log(_frame(spark, LOG, "log string, k int, line string"))
    return rows.select("hash", "author", "message", F.date_format("ts", "yyyy-MM-dd").alias("day"), "change_type", "path", "old_path")


def uuid5(spark, d):
    rows = _frame(spark, [("python.org",), ("www.example.com",)], "n string")
    return rows.select("n", scalars.uuid5_dns(F.col("n")).alias("id"))


def chunk_code(spark, d):
    return tx.code_chunks(_frame(spark, [("a.py", SOURCE)], "path string, source string")).select(F.col("part").cast("int").alias("part"), "first", "last", "opening")


def typescript_symbols(spark, d):
    return _frame(spark, [(TS,)], "source string").select(F.explode(tx.ts_symbols(F.col("source"))).alias("s")).select("s.*")


def parse_query(spark, d):
    rows = _frame(spark, PHOTOS, "id int, q string")
    return rows.select("id", *[c.alias(n) for n, c in tx.parse_photo_query(F.col("q")).items()])


def import_graph(spark, d):
    files = _frame(spark, [(m,) for m in MODULES], "path string")
    return src.import_edges(_frame(spark, IMPORTS, "path string, module string"), files)


def mention_files(spark, d):
    files = _frame(spark, [(f,) for f in FILES], "path string")
    return ev.mentioned_files(_frame(spark, CHUNK_TERMS, "chunk int, term string"), files)


def uses_library(spark, d):
    names = F.create_map(*[F.lit(x) for pair in ALIASES for x in pair])
    rows = _frame(spark, USES, "path string, module string")
    name = F.coalesce(F.try_element_at(names, "module"), "module")
    return rows.select("path", name.alias("library"), scalars.title_case(name).alias("title"))


def dependency_changes(spark, d):
    """Added and removed libraries from the changed lines of manifests."""
    rows = _frame(spark, DIFFS, "hash int, file string, diff string").where("file IN ('requirements.txt', 'package.json')")
    lines = rows.select("hash", F.explode(F.split("diff", "\n")).alias("line")).where("line RLIKE '^[+-]'")
    lib = F.regexp_extract("line", r"^[+-]\s*\"?([A-Za-z0-9_.-]+)", 1)
    return lines.select("hash", lib.alias("library"), F.when(F.col("line").startswith("+"), "added").otherwise("removed").alias("change"))


def validate_changes(spark, d):
    """Why a file change is refused; null if it is fine."""
    rows = _frame(spark, CHANGES, "path string, change_type string, old_path string")
    why = (
        F.when(F.coalesce("path", F.lit("")) == "", "no path").when(~F.col("change_type").isin("A", "M", "D", "R"), "bad type")
        .when((F.col("change_type") == "R") & F.col("old_path").isNull(), "no old path")
    )
    return rows.select("path", "change_type", why.alias("problem"))


def photo_query(spark, d):
    rows = _frame(spark, QUERIES_OF_PHOTOS, "id int, q string")
    return rows.select("id", *[c.alias(n) for n, c in photos.parse(F.col("q")).items()])


CASES = {
    "chunk_code": (chunk_code, "SELECT * FROM (VALUES (0, 0, 2, 'import os'), (1, 3, 6, 'class A:'), (2, 7, 9, 'def main():')) v(part, first, last, opening)"),
    "typescript_symbols": (typescript_symbols, "SELECT * FROM (VALUES ('class', 'Page'), ('interface', 'Props'), ('function', 'render'), ('function', 'load')) v(kind, name)"),
    "parse_query": (parse_query, "SELECT * FROM (VALUES (1, 2017, 2.8::DOUBLE, 50, 100, '1/200', 'canon', 'vacation', 'happy family strasbourg'), (2, NULL, NULL, NULL, NULL, NULL, NULL, '', 'sunset'), (3, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) v(id, year, aperture, focal, iso, shutter, brand, tags, rest)"),
    "import_graph": (import_graph, "SELECT * FROM (VALUES ('app/main.py', 'app/core/util.py', 2), ('app/core/util.py', 'app/core/__init__.py', 2)) v(src, dst, weight)"),
    "mention_files": (mention_files, f"""WITH f AS (SELECT path, regexp_replace(path, '^[^/]+/', '') AS below, regexp_extract(path, '([^/]+)$', 1) AS base FROM {_values([(f,) for f in FILES])} v(path)),
m AS (SELECT * FROM {_values(CHUNK_TERMS)} v(chunk, term)), h AS (SELECT chunk, path, 1.0 AS c FROM m JOIN f ON term = path UNION ALL SELECT chunk, path, 0.95 FROM m JOIN f ON term = below AND below <> path
UNION ALL SELECT chunk, path, 0.7 FROM m JOIN f ON regexp_extract(term, '([^/]+)$', 1) = base AND (SELECT count(*) FROM f g WHERE g.base = f.base) = 1) SELECT chunk, path, CAST(max(c) AS DOUBLE) AS confidence FROM h GROUP BY 1, 2"""),
    "uses_library": (uses_library, f"WITH u AS (SELECT path, coalesce((SELECT lib FROM {_values(ALIASES)} a(m, lib) WHERE m = module), module) AS library FROM {_values(USES)} v(path, module)) SELECT path, library, array_to_string(list_transform(string_split_regex(library, '[-_]+'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM u"),
    "dependency_changes": (dependency_changes, f"WITH r AS (SELECT hash, unnest(string_split(diff, chr(10))) AS line FROM {_values(DIFFS)} v(hash, file, diff) WHERE file IN ('requirements.txt', 'package.json')) SELECT hash, regexp_extract(line, '^[+-]\\s*\"?([A-Za-z0-9_.-]+)', 1) AS library, CASE WHEN line[1] = '+' THEN 'added' ELSE 'removed' END AS change FROM r WHERE regexp_matches(line, '^[+-]')"),
    "validate_changes": (validate_changes, f"SELECT path, change_type, CASE WHEN coalesce(path, '') = '' THEN 'no path' WHEN change_type NOT IN ('A', 'M', 'D', 'R') THEN 'bad type' WHEN change_type = 'R' AND old_path IS NULL THEN 'no old path' END AS problem FROM {_values(CHANGES)} v(path, change_type, old_path)"),
    "photo_query": (photo_query, f"SELECT * FROM {_values(_PHOTOS)} v(id, year, month, camera_make, lens_make, aperture, focal_length, iso, shutter_speed, tags, keywords, fields, rest)"),
    "chunk_markdown": (chunk_markdown, "SELECT * FROM (VALUES ('a.md#1', 'Setup', 71), ('a.md#2', 'Usage: run it!', 84)) v(id, heading, length)"),
    "chunk_slugs": (chunk_slugs, "SELECT * FROM (VALUES ('a.md#top-01', 1), ('a.md#setup-01', 2), ('a.md#notes-01', 3), ('a.md#usage-run-it-02', 2)) v(id, level)"),
    "code_symbols": (code_symbols, "SELECT * FROM (VALUES ('a.py', 'a.py::class::A', 'A', 'class', 4, 'A()'), ('a.py', 'a.py::method::A.go', 'go', 'method', 5, 'go(self, x)'), ('a.py', 'a.py::function::main', 'main', 'function', 8, 'main()')) v(path, symbol_id, name, kind, line, signature)"),
    "code_imports": (code_imports, "SELECT * FROM (VALUES ('os'), ('app.core')) v(module)"),
    "commit_log": (commit_log, "SELECT * FROM (VALUES ('1111111aaa', 'Ann', 'Add core' || chr(9) || 'with tab', '2024-01-02', 'A', 'src/core.py', NULL), ('1111111aaa', 'Ann', 'Add core' || chr(9) || 'with tab', '2024-01-02', 'M', 'README.md', NULL), ('2222222bbb', 'Bob', 'Rename', '2024-01-03', 'R', 'src/main.py', 'src/core.py'), ('3333333ccc', 'Cy', 'Empty', NULL, NULL, NULL, NULL)) v(hash, author, message, day, change_type, path, old_path)"),
    "parse_requirements": (parse_requirements, "SELECT * FROM (VALUES ('numpy', '==1.2'), ('fastapi', '>= 0.1'), ('pandas', '')) v(library, \"constraint\")"),
    "parse_package": (parse_package, "SELECT * FROM (VALUES ('dependencies', 'react', '^18'), ('devDependencies', 'vite', '5')) v(section, library, version)"),
    "parse_requirement_table": (parse_requirement_table, "SELECT * FROM (VALUES ('FR-10-01', 'Login works', 'high'), ('NFR-02-03', 'Fast', 'low')) v(id, description, priority)"),
    "parse_releases": (parse_releases, "SELECT * FROM (VALUES ('1.2.0', '2024-05-01'), ('1.1.9', '2024-04-01')) v(version, date)"),
    "document_titles": (document_titles, "SELECT * FROM (VALUES ('a-b', 'First'), ('c', 'Only'), ('read_me-now', 'Read Me Now')) v(stem, title)"),
    "uuid5": (uuid5, "SELECT * FROM (VALUES ('python.org', '886313e1-3b8a-5372-9b90-0c9aee199e5d'), ('www.example.com', '2ed6657d-e927-568b-95e1-2665a8aea6a2')) v(n, id)"),
    "parse_sprints": (parse_sprints, "SELECT * FROM (VALUES ('1', 'Start', '2024-01-01', '2024-01-14'), ('2', 'Next one', '2024-01-15', '2024-01-28')) v(number, name, start, \"end\")"),
    "parse_bullets": (parse_bullets, "SELECT * FROM (VALUES ('Goal: ship it'), ('second goal')) v(bullet)"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_known_texts(spark, name):
    run, sql = CASES[name]
    got, want = run(spark, None), duckdb.sql(sql)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
