"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text and their beginnings of four to six letters, hashed. The
machine scores b + sum(w) + sum over pairs of <v_i, v_j>, so that two terms together (an insult and
whom it is aimed at) can weigh more than their sum. Terms are selected by distributed counts over a
bounded sample of labelled documents; the machine is fitted on that sample with Adagrad and then
scores every whole text on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from graphloom.functions.scratch import cut
from graphloom.llm.labelled import held_out, sample
from graphloom.llm.texts import small_batches

#: The bound of the training sample: so many labelled rows of either class.
PER_CLASS = 8_000
TERMS = 8_192
LEAST_DOCS = 5
#: Standard deviations by which a term's share of either class must differ: fewer rows, fewer terms.
LEAST_SCORE = 3.5
#: The best so many terms are kept in any case.
FEWEST = 256
FACTORS = 6
HASH_BITS = 26

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its beginnings."""
    parts = [f"={word}"] + [f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n]
    return tuple(xxhash.xxh3_64_intdigest(p) >> (64 - HASH_BITS) for p in parts)


class _Lookup(dict):
    """word -> what `find` makes of its terms; emptied when full."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word):
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = self.find(terms_of(word))
        return value


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lookup = _Lookup(lambda t: t)
    for batch in small_batches(batches, 500):
        terms = [sorted(set(chain.from_iterable(map(lookup.__getitem__, words_of(t))))) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(terms, pa.list_(pa.int32()))], names=["y", "weight", "terms"])


class FactorizationMachine:
    """b, w and v over the selected terms; rows are given as flat term positions with row starts."""

    def __init__(self, terms: np.ndarray, prior: float, seed: int = 5):
        self.terms = terms
        self.bias = float(np.log(prior / (1 - prior)))
        self.w = np.zeros(len(terms))
        self.v = np.random.Generator(np.random.PCG64(seed)).normal(0, 0.01, (len(terms), FACTORS))

    def raw(self, flat: np.ndarray, starts: np.ndarray, rows: int):
        row = np.repeat(np.arange(rows), np.diff(np.append(starts, len(flat))))
        linear = np.bincount(row, self.w[flat], rows)
        v = self.v[flat]
        sums = np.stack([np.bincount(row, v[:, f], rows) for f in range(FACTORS)], axis=1)
        squares = np.bincount(row, (v * v).sum(axis=1), rows)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), row, v, sums

    def score(self, flat, starts, rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(flat, starts, rows)[0], -40, 40)))

    def fit(self, lists: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-3):
        rng = np.random.Generator(np.random.PCG64(9))
        seen = [1e-6, np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6)]
        weight = weight / weight.mean()
        for _ in range(epochs):
            order = rng.permutation(len(lists))
            for at in range(0, len(order), 256):
                part = order[at : at + 256]
                sizes = np.array([len(lists[i]) for i in part])
                flat = np.concatenate([lists[i] for i in part]) if sizes.sum() else np.empty(0, np.int64)
                raw, row, v, sums = self.raw(flat, np.cumsum(sizes) - sizes, len(part))
                off = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[part]) * weight[part] / len(part)
                used, where = np.unique(flat, return_inverse=True)
                dw = np.bincount(where, off[row], len(used)) + decay * self.w[used] / len(part)
                pull = off[row][:, None] * (sums[row] - v)
                dv = np.stack([np.bincount(where, pull[:, f], len(used)) for f in range(FACTORS)], axis=1) + decay * self.v[used] / len(part)
                seen[0] += off.sum() ** 2
                self.bias -= rate * off.sum() / np.sqrt(seen[0])
                seen[1][used] += dw**2
                self.w[used] -= rate * dw / np.sqrt(seen[1][used])
                seen[2][used] += dv**2
                self.v[used] -= rate * 0.3 * dv / np.sqrt(seen[2][used])
        self.bias -= self.parting(lists, y, weight)
        return self

    def parting(self, lists: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> float:
        """The raw score that parts the sample's classes with least weighted error: the middle of the
        best gap. One toxic term among hundreds must suffice, which a shrunken fit alone places low."""
        raws = []
        for at in range(0, len(lists), 512):
            part = lists[at : at + 512]
            sizes = np.array([len(x) for x in part])
            raws.append(self.raw(np.concatenate(part), np.cumsum(sizes) - sizes, len(part))[0])
        raw = np.concatenate(raws)
        order = np.argsort(raw, kind="stable")
        raw, missed = raw[order], weight[order]
        # Errors with the cut below row i: negatives from i on and positives before i.
        errors = np.append(0, np.cumsum(np.where(y[order] == 1, missed, 0))) + np.append(np.cumsum(np.where(y[order] == 0, missed, 0)[::-1])[::-1], 0)
        edges = np.concatenate([[raw[0] - 1], raw, [raw[-1] + 1]])
        best = np.flatnonzero(errors == errors.min())
        at = best[np.argmax(edges[best + 1] - edges[best])]
        return float((edges[at] + edges[at + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, learnable, per_class: int = PER_CLASS) -> FactorizationMachine:
    """Fits on at most per_class labelled rows of either class. With labels of one class only, or
    none, the machine has no terms and scores 0, 1 or 0.5 respectively."""
    rows = sample(docs, labels, "toxic", learnable, per_class).select("text", "y", "weight")
    rows = cut(rows.mapInArrow(_term_rows, "y int, weight double, terms array<int>"), "terms")
    totals = {r.y: (r.n, r.w) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("w")).collect()}
    if len(totals) < 2:
        prior = {(): 0.5, (0,): 1e-6, (1,): 1 - 1e-6}[tuple(totals)]
        return FactorizationMachine(np.empty(0, np.int64), prior)
    ones, zeros = totals[1][0], totals[0][0]
    # A term's score: by how much its share of either class differs, in standard deviations.
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum(F.col("y")).alias("a"), F.sum(1 - F.col("y")).alias("b")
    ).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    p = (F.col("a") + F.col("b")) / (ones + zeros)
    gap = F.abs(F.col("a") / ones - F.col("b") / zeros) / F.sqrt(p * (1 - p) + 1e-12)
    sure = gap / (1 / ones + 1 / zeros) ** 0.5 >= LEAST_SCORE
    best = counts.orderBy(F.desc(gap), "term").limit(TERMS).select("term", sure.alias("sure")).toArrow()
    kept = best.slice(0, max(FEWEST, sum(best["sure"].to_pylist())))
    terms = np.sort(kept["term"].to_numpy().astype(np.int64))
    known = F.broadcast(rows.sparkSession.createDataFrame([(terms.tolist(),)], "known array<int>"))
    found = rows.join(known).select("y", "weight", F.array_intersect("terms", "known").alias("terms")).toArrow().combine_chunks()
    column = found["terms"].combine_chunks()
    lists = np.split(np.searchsorted(terms, column.flatten().to_numpy()), np.cumsum(column.value_lengths().to_numpy())[:-1])
    mass = {y: n * w for y, (n, w) in totals.items()}
    machine = FactorizationMachine(terms, mass[1] / (mass[0] + mass[1]))
    return machine.fit(lists, found["y"].to_numpy().astype(np.float64), found["weight"].to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """docs with a column score added: the probability of label 1 for each whole text. Null and empty
    texts get the score of a text without known terms."""
    position = {int(t): k for k, t in enumerate(machine.terms)}
    shared = docs.sparkSession.sparkContext.broadcast((position, machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position, machine = shared.value
        lookup = _Lookup(lambda ts: tuple(position[t] for t in ts if t in position))
        for batch in small_batches(batches):
            lists = [list(set(chain.from_iterable(map(lookup.__getitem__, words_of(t))))) for t in batch.column(text_at).to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
            scores = machine.score(flat, np.cumsum(sizes) - sizes, len(lists))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=names)

    plain = docs.drop("score")
    text_at, names = plain.columns.index("text"), [*plain.columns, "score"]
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    return plain.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; rows that are held out are never
    learnt from. Further columns of either table are ignored, repeated rows score alike."""
    machine = train(docs, labels, ~held_out(5, 0))
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), machine)
    return rows.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
