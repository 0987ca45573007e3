"""Source divergence audit over de-duplicated count columns.

Words are counted by language, source and term: each task merges what it meets in a table of bounded
size, so frequent words and large sources are summed before the shuffle. A term's counts in the sources
of its language form a sparse vector (sources in order, counts above zero). Terms with the same vector
cannot be told apart by any comparison of sources, so vectors are grouped and each is evaluated once:
its value times the number of its terms. Blocks of vectors meet the table of their language's groups;
for every pair of sources only the vectors in which either occurs are visited, what is left has the same
value for all. Original terms come back for the ranks alone, through the vectors that can reach them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut, join_checked
from graphloom.llm.texts import byte_texts

#: Documents that a term must be in, within its language; ranks of part `term` that are reported.
LEAST = 3
RANKS = 200
#: Distinct (language, source, term) that a task counts before it passes them on.
COUNTED = 400_000
#: Vectors of one block.
BLOCK = 8192
#: Fixed value of the measure: probabilities are whole numbers of this unit.
UNIT = 1_000_000_000

#: Bytes outside letters and non-ASCII become spaces, A-Z small letters.
_LETTERS = bytes(c if c > 0x7F or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The words of a text: runs of ASCII letters (lower-cased) and non-ASCII characters."""
    return text.translate(_LETTERS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> lang, source, term, n, docs."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0
    for batch in batches:
        names = batch.schema.names
        langs, sources = (batch.column(names.index(c)).to_pylist() for c in ("lang", "source"))
        texts = batch.column(names.index("text"))
        for at in range(batch.num_rows):
            words = Counter(terms_of(byte_texts(texts.slice(at, 1))[0]))
            if not words:
                continue
            group = (langs[at], sources[at])
            known, within = counts.setdefault(group, Counter()), docs.setdefault(group, Counter())
            held -= len(known)
            known.update(words)
            within.update(words.keys())
            held += len(known)
            if held > COUNTED:
                yield from _counted(counts, docs)
                counts, docs, held = {}, {}, 0
    yield from _counted(counts, docs)


def _counted(counts: dict, docs: dict, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for (lang, source), known in counts.items():
        terms, n, within = list(known), list(known.values()), docs[lang, source]
        for at in range(0, len(terms), rows):
            part = terms[at : at + rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(part), pa.string()),
                    "source": pa.array([source] * len(part), pa.string()),
                    "term": pa.array(part, pa.binary()).cast(pa.string()),
                    "n": pa.array(n[at : at + rows], pa.int64()),
                    "docs": pa.array([within[t] for t in part], pa.int64()),
                }
            )


def count_vectors(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, text -> (lang, term, vector) of the terms in at least so many rows of their language;
    the vector lists (source, n) by source, zeros left out."""
    counted = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # One dealing by (lang, term) serves both sums; each task sends a term once a source.
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        by_source.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least).drop("docs")
    )


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (size + terms)), exactly."""
    top = (n.cast("decimal(19,0)") + 1) * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top.cast("decimal(38,0)"), (size + terms).cast("decimal(38,0)"))


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pairs(key, vectors: pa.Table, groups: pa.Table) -> pa.Table:
    """A block of distinct vectors (vector, m) against the groups (source, size, terms) of their language."""
    names = groups["source"].to_pylist()
    order = sorted(range(len(names)), key=lambda k: names[k].encode())
    names = [names[k] for k in order]
    bottom = [groups["size"][k].as_py() + groups["terms"][k].as_py() for k in order]
    place, s = {name: k for k, name in enumerate(names)}, len(names)
    total = np.zeros((s, s), np.int64)
    if vectors.num_rows:
        m = vectors["m"].to_numpy()
        none = np.array([1 + UNIT // b for b in bottom], np.int64)
        flat = vectors["vector"].combine_chunks()
        if isinstance(flat, pa.ChunkedArray):
            flat = pa.concat_arrays(flat.chunks)
        entries = flat.flatten()
        row = np.repeat(np.arange(len(m)), np.diff(flat.offsets.to_numpy()))
        column = np.array([place[x] for x in entries.field("source").to_pylist()], np.int64)
        p = np.tile(none, (len(m), 1))
        p[row, column] = [1 + UNIT * (n + 1) // bottom[c] for n, c in zip(entries.field("n").to_pylist(), column.tolist())]
        there = np.zeros((len(m), s), bool)
        there[row, column] = True
        seen = np.zeros((s, s), np.int64)
        for a in range(s):
            rows = np.flatnonzero(there[:, a])
            if not len(rows):
                continue
            own, others, weight, absent = p[rows, a][:, None], p[rows], m[rows][:, None], ~there[rows]
            total[a] += (weight * _divergence(own, others)).sum(axis=0)
            seen[a] += weight.sum()
            total[:, a] += (weight * _divergence(others, own) * absent).sum(axis=0)
            seen[:, a] += (weight * absent).sum(axis=0)
        total += (int(m.sum()) - seen) * _divergence(none[:, None], none[None, :])
    left, right = np.nonzero(~np.eye(s, dtype=bool))
    return pa.table({
        "lang": pa.array([groups["lang"][0].as_py()] * len(left), pa.string()), "source": pa.array([names[k] for k in left], pa.string()),
        "item": pa.array([names[k] for k in right], pa.string()), "value": total[left, right],
    })


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank (from 1 per group and part; value descending, then item).

    Part `pair` compares each (lang, source) group with every other source of its language, part `term`
    lists the terms that the group uses more than its language does, the first `ranks` of them. Null
    text, lang and source count as empty; groups without any kept term compare by the share that no
    occurrence has, and with 0 where the language has no kept term. Repeated rows count as documents of
    their own. An empty table gives an empty result; further columns are ignored.
    """
    body = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = cut(count_vectors(body, least), "terms")
    spoken = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    used = terms.select("lang", F.explode("vector").alias("v")).groupBy("lang", F.col("v.source").alias("source")).agg(F.sum("v.n").alias("size"))
    groups = cut(
        body.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(spoken, "lang", "left")
        .select("lang", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms")),
        "groups",
    )
    vectors = cut(
        terms.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("m"))
        .withColumn("total", F.aggregate("vector", F.lit(0).cast("long"), lambda s, v: s + v["n"])), "vectors",
    )

    # Pairs: blocks of distinct vectors, each with the groups of its language.
    blocks = cut(vectors.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = vectors.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("vector"), "blocks").cast("int").alias("block"), "vector", "m")
    sides = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "size", "terms")
    sums = (
        dealt.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block"))
        .applyInArrow(_pairs, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    # Languages without a kept term have no vectors.
    mute = groups.where("terms = 0")
    other = mute.select("lang", F.col("source").alias("item"))
    pairs = sums.unionByName(mute.select("lang", "source").join(other, "lang").where("source <> item").withColumn("value", F.lit(0).cast("long")))
    by_value = [F.desc("value"), "item"]
    window = Window.partitionBy("lang", "source")
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(window.orderBy(*by_value)))

    # Terms: each distinct vector has one value for each of its sources.
    whole = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"))
    entry = vectors.select("lang", "vector", "total", F.explode("vector").alias("v")).select("lang", "vector", "total", F.col("v.source").alias("source"), F.col("v.n").alias("n"))
    compared = entry.join(groups, ["lang", "source"]).join(whole, "lang").select(
        "lang", "source", "vector", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q")
    )
    valued = compared.where("p > q").select("lang", "source", "vector", _value(F.col("p"), F.col("q")).alias("value"))
    # A vector that as many better ones precede has no term in the ranks.
    near = cut(valued.withColumn("r", F.rank().over(window.orderBy(F.desc("value")))).where(F.col("r") <= ranks).drop("r"), "near")
    of = near.withColumnsRenamed({"lang": "of_lang", "vector": "of_vector"})
    named = join_checked(terms, of, (F.col("lang") == F.col("of_lang")) & (F.col("vector") == F.col("of_vector")), max_rows=200_000)
    named = named.select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    best = named.withColumn("rank", F.row_number().over(window.orderBy(*by_value))).where(F.col("rank") <= ranks)
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def query(spark, sf_dir):
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS terms, sum(total) AS size FROM kept GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS size
      FROM (SELECT DISTINCT lang, source FROM d) d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT)) // CAST(g.size + v.terms AS HUGEINT) AS p,
             1 + (1000000000 * CAST(k.total + 1 AS HUGEINT)) // CAST(v.size + v.terms AS HUGEINT) AS q
      FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(e.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""
