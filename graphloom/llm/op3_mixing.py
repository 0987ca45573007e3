"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (words) within each source. A source's target gives every
document the same number of whole copies; what remains of the budget is first spread evenly over the
lengths and then fitted, to the optimum, by a bounded-knapsack dynamic programme over length counts. The
counts tell how many documents of each length get one more copy; which ones is decided by a seeded
hash. Only length counts meet in one task, never documents.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut, join_checked

#: Fixed values of the mix: weights by source order, share of all sizes, most copies of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words that the dynamic programme first decides about; it widens until the budget is met or nothing is left to free.
ROOM = 16_384
#: Documents of one length are ranked in hash buckets of about this size.
RANKED = 8192


def nearest_sum(items: list[tuple[int, int]], target: float) -> dict[int, int]:
    """Bounded knapsack: how many of each (length, count) give the sum nearest to target, the lower one
    of two equally near. Bit s of a whole number says that s can be made; counts split in powers of two.
    Only every so many steps are kept, the ones between are made again on the way back."""
    aim = math.floor(target)
    top = aim + max((n for n, _ in items), default=0)
    mask = (1 << (top + 1)) - 1
    steps = []
    for n, c in sorted(items, reverse=True):
        c, k = min(c, top // n), 1
        while c > 0:
            k = min(k, c)
            steps.append((n, k))
            c, k = c - k, 2 * k
    stride = max(1, math.isqrt(len(steps)))
    reach, kept, done = 1, [], 0
    for n, k in steps:
        if target == aim and reach >> aim & 1:
            break
        if done % stride == 0:
            kept.append(reach)
        reach |= (reach << n * k) & mask
        done += 1
    low = (reach & ((1 << (aim + 1)) - 1)).bit_length() - 1
    above = reach >> (aim + 1)
    high = (above & -above).bit_length() + aim if above else None
    at = low if high is None or target - low <= high - target else high
    taken: dict[int, int] = {}
    for first in range((done - 1) // stride * stride, -1, -stride) if done else ():
        before = [kept[first // stride]]
        for n, k in steps[first : min(first + stride, done) - 1]:
            before.append(before[-1] | (before[-1] << n * k) & mask)
        for (n, k), known in zip(reversed(steps[first : min(first + stride, done)]), reversed(before)):
            if not known >> at & 1:
                taken[n] = taken.get(n, 0) + k
                at -= n * k
    return taken


def fit_budget(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take (at most the count) so that the words come as near to budget as
    any choice does; ties go below.

    Lengths are divided by their greatest common divisor. An even spread comes first, rounded up from
    the longest on while there is room; the programme then decides anew about a number of copies of
    each length, of the short ones first. It widens until the budget is met to the word (or to the
    nearest multiple of the divisor), or until it has every copy that can matter: with whole numbers, a
    choice that meets a sum can be turned into one that differs from the spread in at most 3 * longest
    copies (order the differences so that partial sums stay within the longest length; where one
    repeats, the copies between cancel), so no more of a length need be free.
    """
    unit = math.gcd(*(n for n, c in lengths.items() if n > 0 and c > 0))
    if budget <= 0 or not unit:
        return {}
    counts = {n // unit: c for n, c in lengths.items() if n > 0 and c > 0}
    total, aim = sum(n * c for n, c in counts.items()), budget / unit if budget % unit else budget // unit
    if aim >= total:
        return {n * unit: c for n, c in counts.items()}
    taken = {n: c * budget // (total * unit) for n, c in counts.items()}
    rest = aim - sum(n * c for n, c in taken.items())
    order = sorted(counts)
    for n in reversed(order):
        if taken[n] < counts[n] and rest >= n:
            taken[n], rest = taken[n] + 1, rest - n
    best_gap, room, enough = abs(aim - round(aim)) if budget % unit else 0, ROOM, 3 * order[-1] + 2
    while True:
        free, used, k = dict.fromkeys(order, 0), 0, 1
        cost = lambda n, k: n * (min(taken[n], k) + min(counts[n] - taken[n], k))  # noqa: B023, E731
        most = {n: min(enough, max(taken[n], counts[n] - taken[n])) for n in order}
        while k < 2 * max(most.values()):
            for n in order:
                more = cost(n, min(k, most[n])) - cost(n, free[n])
                if used + more <= room:
                    free[n], used = max(free[n], min(k, most[n])), used + more
            k *= 2
        base = {n: taken[n] - min(taken[n], free[n]) for n in order}
        target = aim - sum(n * c for n, c in base.items())
        chosen = nearest_sum([(n, cost(n, free[n]) // n) for n in order if free[n]], target)
        result = {n: base[n] + chosen.get(n, 0) for n in order}
        gap = abs(aim - sum(n * c for n, c in result.items()))
        if gap <= best_gap or free == most:
            return {n * unit: c for n, c in result.items()}
        room *= 8


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """A source's length counts -> whole copies and extra copies by length."""
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    base = min(MOST, math.floor(target / size)) if size else 0
    budget = 0 if base >= MOST else math.floor(target - base * size + 0.5)
    extra = fit_budget(dict(zip(pdf["size"].tolist(), pdf["docs"].tolist())), budget)
    return pdf.assign(base=base, extra=[extra.get(n, 0) for n in pdf["size"].tolist()])[
        ["source", "size", "docs", "source_size", "target", "base", "extra"]
    ]


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with target: SHARE of all sizes by weight, none above MOST times its
    size. The level that the weights are scaled by is read off the sources ordered by the level at
    which they stop; one row a source meets in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    cap = F.col("source_size") * MOST
    rows = sizes.withColumn("weight", weight).withColumn("stops", cap / F.col("weight"))
    order = Window.orderBy("stops", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * SHARE
    rows = rows.withColumn("level", (budget - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("level") <= F.col("stops"), F.struct("stops", "level"))).over(every)
    rows = rows.withColumn("found", level["level"])
    return rows.select(
        "source", "source_size",
        F.when(F.col("found").isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("found") * F.col("weight"))).alias("target"),
    )


def mix(docs: DataFrame, seed: int = 7, *, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document: 0, 1 or 2 times
    its size) for every row of docs; with carry, the row itself as a struct `row` too.

    Size counts the words of the whole text; null and blank texts have size 0 and are taken 0 times.
    A null source is a source of its own, the last by name. Rows with equal doc_id, source and size
    are interchangeable, so reruns give the same rows. An empty table gives an empty result; further
    columns are ignored.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    order = F.xxhash64(F.lit(seed), "doc_id", "text").alias("order")
    sized = cut(docs.select(F.col("doc_id"), F.col("source"), words.alias("size"), order, *row), "sized", "zstd" if carry else "snappy")
    lengths = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "lengths")
    aimed = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")))
    plan = lengths.join(aimed.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = cut(
        plan.groupBy("source").applyInPandas(
            _plan, "source string, size long, docs long, source_size long, target double, base int, extra long"
        ),
        "plan",
    )
    key = lambda a, b: a["source"].eqNullSafe(b["p_source"]) & (a["size"] == b["p_size"])
    named = plan.select(
        F.col("source").alias("p_source"), F.col("size").alias("p_size"),
        "docs", "source_size", "target", "base", "extra", F.ceil(F.col("docs") / RANKED).alias("buckets"),
    )
    planned = join_checked(sized, named, key(sized, named), max_rows=200_000).drop("p_source", "p_size")
    planned = planned.withColumn("bucket", F.pmod("order", "buckets"))
    whole = planned.where("extra = 0 or extra = docs").withColumn("more", F.when(F.col("extra") > 0, 1).otherwise(0))

    # Lengths of which some documents get one more copy: whole hash buckets first, then ranks in one bucket.
    some = planned.where("extra > 0 and extra < docs")
    filled = some.groupBy("source", "size", "bucket", "extra").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source", "size").orderBy("bucket")
    edge = cut(
        filled.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        .where("before < extra and before + n >= extra")
        .select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("bucket").alias("edge"), (F.col("extra") - F.col("before")).alias("need")),
        "edge",
    )
    some = join_checked(some, edge, key(some, edge), max_rows=200_000).drop("p_source", "p_size")
    outside = some.where("bucket <> edge").withColumn("more", F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("order", "doc_id", *(["row"] if carry else [])))
    ranked = some.where("bucket = edge").withColumn("more", F.when(rank <= F.col("need"), 1).otherwise(0))
    result = ["doc_id", "size", "source_size", "target", (F.col("size") * (F.col("base") + F.col("more"))).cast("long").alias("taken"), *(["row"] if carry else [])]
    return whole.select(*result).unionAll(outside.select(*result)).unionAll(ranked.select(*result))


def query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
