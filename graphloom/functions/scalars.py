"""Scalar expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by category.
DOC_EXT = [".md", ".txt", ".rst"]
CODE_EXT = [".py", ".ts", ".tsx", ".js", ".jsx"]


def file_name(name: Column, key: Column) -> Column:
    """A file name for a row of the part table: name, key and an extension by key."""
    endings = [".py", ".json", ".md", ".yaml", ".tsx", ".txt", ".css", ""]
    ending = F.element_at(F.array(*map(F.lit, endings)), (F.pmod(key, F.lit(8)) + 1).cast("int"))
    return F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit("_"), key.cast("string"), ending)


def file_class(path: Column) -> Column:
    """By substring, in this order: a .json file counts as code because .js comes first."""
    has = lambda *xs: F.array_contains(F.array(*[path.contains(x) for x in xs]), True)
    return (
        F.when(has(".py", ".js", ".ts"), "code").when(has(".md", ".txt"), "document")
        .when(has(".json", ".yaml", ".yml"), "config").otherwise("other")
    )


def file_category(path: Column) -> Column:
    """By extension proper."""
    ext = F.regexp_extract(F.lower(path), r"(\.[a-z]+)$", 1)
    return F.when(ext.isin(*DOC_EXT), "doc").when(ext.isin(*CODE_EXT), "code").otherwise("other")


def rename_target(path: Column) -> Column:
    """`a/{old => new}/f` becomes `a/new/f`; `old => new` becomes `new`."""
    inner = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.replace(F.regexp_replace(inner, r"^.* => ", ""), F.lit("//"), F.lit("/"))


def slugify(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9 -]", "")
    return F.trim(F.regexp_replace(kept, r"[ -]+", "-"), F.lit("-"))


def redact_tokens(text: Column) -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9]{32,}", "<redacted>")


def escape_query(text: Column) -> Column:
    """Escapes the special characters of a full-text query."""
    return F.regexp_replace(text, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")


def title_case(name: Column) -> Column:
    return F.initcap(F.regexp_replace(name, r"[-_]+", " "))


def uuid5_dns(name: Column) -> Column:
    """A version 5 UUID in the DNS name space."""
    space = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(x, F.lit(float(high))))


def threshold_status(value: Column, ok: float, warn: float, higher_is_better: bool = True) -> Column:
    if higher_is_better:
        return F.when(value >= ok, "ok").when(value >= warn, "warn").otherwise("critical")
    return F.when(value <= ok, "ok").when(value <= warn, "warn").otherwise("critical")
