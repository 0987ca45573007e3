"""Filters, bounded range joins, paging and grouping helpers on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut


def between(ts: Column, start=None, end=None, keep_null: bool = False) -> Column:
    """A closed range whose bounds are each optional; a null time passes only if keep_null."""
    test = F.lit(True)
    if start is not None:
        test = test & (ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        test = test & (ts <= F.lit(end).cast("timestamp"))
    return (ts.isNull() | test) if keep_null else test


def payload_filter(spec: dict) -> Column:
    """A predicate from a payload filter: a scalar matches, a list matches any, a dict with gte, lte,
    gt or lt is a range; all are AND-ed."""
    test = F.lit(True)
    ops = {"gte": Column.__ge__, "lte": Column.__le__, "gt": Column.__gt__, "lt": Column.__lt__}
    for name, want in spec.items():
        col = F.col(name)
        if isinstance(want, dict):
            for op, bound in want.items():
                test = test & ops[op](col, F.lit(bound))
        elif isinstance(want, (list, tuple)):
            test = test & col.isin(*want)
        else:
            test = test & (col == F.lit(want))
    return test


def any_contains(columns: list[str], needle: str) -> Column:
    """Whether any of the columns, as text, contains needle (case-sensitive)."""
    return F.exists(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: F.coalesce(x.contains(needle), F.lit(False)))


def keyset_page(df: DataFrame, ts: str, rid: str, size: int, after: tuple | None = None) -> DataFrame:
    """The next page in the order (ts desc, rid desc), strictly after a cursor (ts, rid)."""
    if after is not None:
        at, last = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        df = df.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(rid) < last)))
    return df.orderBy(F.desc(ts), F.desc(rid)).limit(size)


#: Entries of a list in product_by(), pairs of a cell, pairs of a task.
LIST, CELL, TASK = 8192, 1 << 24, 1 << 24


def product_by(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined to right (key and one other column) on a key that many rows of both sides share. Pairs are many
    more than rows, so the number of tasks follows the pairs: a key is cut into cells, a list of some LIST rows of
    right times a share of left, and the join moves rows and lists to cells. Pairs are listed there and
    nowhere written or shuffled. The driver holds their number."""
    left, right = cut(left, "left"), cut(right, "right")
    value = next(c for c in right.columns if c != key)
    many = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    lists, share = F.ceil(F.col("_r") / LIST), F.ceil(F.col("_l") * F.least(F.col("_r"), F.lit(LIST)) / CELL)
    sizes = cut(many(left, "_l").join(many(right, "_r"), key).select(key, (F.col("_l") * F.col("_r")).alias("_pairs"), lists.alias("_lists"), share.alias("_shares")), "sizes")
    tasks = max(1, -(-int(sizes.agg(F.sum("_pairs")).first()[0] or 0) // TASK))
    sizes, every = sizes.drop("_pairs"), lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    place, part = F.pmod(F.xxhash64(value), F.col("_lists")), F.pmod(F.xxhash64(*left.columns), F.col("_shares"))
    packed = right.join(sizes, key).groupBy(key, "_shares", place.alias("_place")).agg(F.collect_list(value).alias("_packed"))
    packed = packed.select(key, "_place", every("_shares").alias("_part"), "_packed")
    dealt = left.join(sizes, key).select(*left.columns, every("_lists").alias("_place"), part.alias("_part"))
    cell = [key, "_place", "_part"]
    met = dealt.repartition(tasks, *cell).join(packed.repartition(tasks, *cell).hint("shuffle_hash"), cell)
    return met.withColumn(value, F.explode("_packed")).drop("_place", "_part", "_packed")


def in_windows(points: DataFrame, ts: str, windows: DataFrame, start: str, end: str) -> DataFrame:
    """Points joined to the windows of whole days that hold them. Windows are exploded to their days
    and joined on the day, so the join is an equi-join whatever the number of windows."""
    days = windows.withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    return points.withColumn("_day", F.to_date(ts)).join(days, "_day").drop("_day")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def capped(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows for each key, in the order, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
