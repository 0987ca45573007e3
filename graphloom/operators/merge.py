"""Keyed upserts: a table and a batch of changes become a new table.

Parquet has no MERGE, so each rule is a full join or an anti join on the key and a rewrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _merged(old: DataFrame, new: DataFrame, keys: list[str], pick) -> DataFrame:
    values = [c for c in old.columns if c not in keys]
    left = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in values])
    right = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    both = left.join(right, keys, "full_outer")
    return both.select(*keys, *[pick(F.col(f"_old_{c}"), F.col(f"_new_{c}")).alias(c) for c in values])


def merge_keep_first(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The first value that is not null stays."""
    return _merged(old, new, keys, lambda o, n: F.coalesce(o, n))


def merge_keep_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new value that is not null replaces the old one."""
    return _merged(old, new, keys, lambda o, n: F.coalesce(n, o))


def merge_overwrite(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch replace whole rows."""
    return old.join(new, keys, "left_anti").unionByName(new.select(*old.columns))


def merge_list(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The set union of a list column."""
    empty = F.array().cast(old.schema[column].dataType)
    return _merged(old.select(*keys, column), new.select(*keys, column), keys, lambda o, n: F.sort_array(F.array_union(F.coalesce(o, empty), F.coalesce(n, empty))))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key is not there yet."""
    return new.join(old, keys, "left_anti")


def replace_for_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """For every key in the batch, its rows are replaced as a whole; other keys stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def stale(edges: DataFrame, processed: DataFrame, key: str, run_id) -> DataFrame:
    """Edges of processed keys that an earlier run wrote."""
    return edges.join(processed, key, "left_semi").where(F.col("run_id") != F.lit(run_id))
