"""The open query surface: read-only SQL over the bound views, with a row limit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import bind
from graphloom.functions.text import DECODED, _decoded
from graphloom.session import TABLES, table

#: Fixed value: the most rows that an ad-hoc query returns.
MOST_ROWS = 4000


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """The star-schema tables and the graph views as temporary views."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name in ("commits", "files", "touches", "sprints"):
        getattr(bind, name)(spark, sf_dir).createOrReplaceTempView(name)


class _Lines:
    """numbered_lines(text) in SQL: the lines of a text with their numbers from 1."""

    def eval(self, text: str):
        if text is not None:
            yield from enumerate(text.split("\n"), 1)


def register_functions(spark: SparkSession) -> None:
    """The library's functions under SQL names: decode_any(bytes), a vectorised function that gives a struct, and
    numbered_lines(text), a table function for LATERAL joins. Own functions are registered likewise."""
    spark.udf.register("decode_any", F.pandas_udf(_decoded, DECODED))
    spark.udtf.register("numbered_lines", F.udtf(_Lines, returnType="number int, line string"))


def read_only(spark: SparkSession, text: str, limit: int = MOST_ROWS) -> DataFrame:
    """Runs one SELECT or WITH statement; anything else raises ValueError. Spark's own parser decides what
    the statement means; a statement that writes is a command there and never starts with these words."""
    body = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip().rstrip(";")
    if not re.match(r"(?is)(select|with)\b", body) or ";" in body or re.search(r"(?is)\binsert\s+(into|overwrite)\b", body):
        raise ValueError("only one SELECT or WITH statement is allowed")
    return spark.sql(body).limit(limit)
