"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts are described by hashed terms: the shapes of their words (case, trailing marks, length), words,
and how much of the text repeats. A bounded sample of labelled documents gives term weights and, by a
singular value decomposition, a latent space; its vectors are broadcast with their labels. Every
document is projected into the space, its exact cosines with all labelled vectors are computed as
blocked matrix products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from graphloom.functions.scratch import cut
from graphloom.llm.labelled import held_out, sample
from graphloom.llm.texts import small_batches

#: The bound of the labelled sample: so many rows of either class are broadcast.
PER_CLASS = 2_000
WORD_DIMS = 1_024
STYLE_DIMS = 1_024
DIMS = WORD_DIMS + STYLE_DIMS
LATENT = 64
NEIGHBOURS = 15
SHARPNESS = 8
#: Style terms count so much more than words.
STYLE = 6.0


def _dim(kind: str, term: str) -> int:
    base, dims = (0, WORD_DIMS) if kind == "w" else (WORD_DIMS, STYLE_DIMS)
    return base + xxhash.xxh3_64_intdigest(f"{kind}{term}") % dims


def _shape(word: str) -> str:
    core = word.rstrip("!?.,;:*#%&$|-_=~^'\")]}>")
    case = "u" if core.isupper() and len(core) > 1 else "t" if core.istitle() else "l" if core.islower() else "n" if core.isdigit() else "-" if not core else "x"
    return f"{case}{min(len(core), 16) // 4}{word[len(core):][:3]}"


class _Dims(dict):
    """word -> (its word dimension, its shape dimension); emptied when full."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = (_dim("w", word.lower()), _dim("s", _shape(word)))
        return value


def _share(part: int, whole: int) -> int:
    """A share in eight steps."""
    return min(8, 8 * part // whole) if whole else 0


def describe(text: str | None, dims: _Dims) -> np.ndarray:
    """Term frequencies of a whole text, as a unit vector of logarithmic counts a block."""
    out = np.zeros(DIMS, np.float32)
    words = text.split() if text else []
    counts = Counter(words)
    for word, n in counts.items():
        w, s = dims[word]
        out[w] += n
        out[s] += n
    lines = [x for x in text.split("\n") if x.strip()] if text else []
    twice = sum(map(str.__eq__, words, words[1:]))
    marks = sum(n for word, n in counts.items() if not word[-1].isalnum())
    style = {
        "empty": not words,
        f"again{_share(twice, len(words))}": True,
        f"fresh{_share(len(counts), len(words))}": True,
        f"lines{_share(len(lines) - len(set(lines)), len(lines))}": True,
        f"marks{_share(marks, len(words))}": True,
        f"size{min(len(words), 65536).bit_length()}": True,
    }
    np.log1p(out, out)
    for block in (slice(0, WORD_DIMS), slice(WORD_DIMS, DIMS)):
        norm = np.sqrt((out[block] ** 2).sum())
        if norm:
            out[block] /= norm
    for term, holds in style.items():
        if holds:
            out[_dim("s", f"!{term}")] += 0.5
    out[WORD_DIMS:] *= STYLE
    return out


class LatentSpace:
    """The projection, the labelled vectors in it, and the vote."""

    def __init__(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.y, self.weight = y, weight
        self.prior = float((y * weight).sum() / weight.sum()) if len(y) else 0.5
        present = (rows > 0).sum(axis=0)
        self.idf = np.log((1 + len(rows)) / (1 + present)).astype(np.float32) + np.float32(0.1)
        weighted = rows * self.idf
        values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64)) if len(y) else (np.zeros(0), np.zeros((DIMS, 0)))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :LATENT]).astype(np.float32)
        self.vectors = self.project(rows)

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows * self.idf) @ self.basis
        return latent / np.maximum(np.sqrt((latent**2).sum(axis=1, keepdims=True)), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if len(set(self.y.tolist())) < 2:
            return np.full(len(rows), self.prior)
        cosines = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(cosines, cosines.shape[1] - k, axis=1)[:, cosines.shape[1] - k :]
        sims = np.clip(np.take_along_axis(cosines, near, axis=1).astype(np.float64), 0, 1) ** SHARPNESS
        # The sample holds both classes alike: a vote weighs as many rows as its row stands for,
        # dampened, with a small vote for the prior.
        votes = sims * np.sqrt(self.weight[near])
        return ((votes * self.y[near]).sum(axis=1) + 1e-3 * self.prior) / (votes.sum(axis=1) + 1e-3)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    dims = _Dims()
    for batch in small_batches(batches, 200):
        rows = [describe(t, dims) for t in batch.column(0).to_pylist()]
        at = [np.flatnonzero(r) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(rows, at)], pa.list_(pa.float32()))],
            names=["y", "weight", "at", "value"],
        )


def train(docs: DataFrame, labels: DataFrame, learnable, per_class: int = PER_CLASS) -> LatentSpace:
    """Fits on at most per_class labelled rows of either class; these rows (at most DIMS numbers each)
    are all that reaches the driver. With no labels or one class the vote is the prior."""
    rows = sample(docs, labels, "quality", learnable, per_class).select("text", "y", "weight")
    described = cut(rows.mapInArrow(_rows, "y int, weight double, at array<int>, value array<float>"), "described")
    found = described.orderBy("y", F.xxhash64("at", "value")).toArrow()
    matrix = np.zeros((found.num_rows, DIMS), np.float32)
    at, value = found["at"].combine_chunks(), found["value"].combine_chunks()
    matrix[np.repeat(np.arange(found.num_rows), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = value.flatten().to_numpy()
    return LatentSpace(matrix, found["y"].to_numpy().astype(np.int64), found["weight"].to_numpy())


def score(docs: DataFrame, space: LatentSpace) -> DataFrame:
    """docs with a column score added. Null and empty texts are described as empty and voted on alike."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    plain = docs.drop("score")
    text_at, names = plain.columns.index("text"), [*plain.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, dims = shared.value, _Dims()
        for batch in small_batches(batches, 500):
            rows = np.stack([describe(t, dims) for t in batch.column(text_at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(space.score(rows))], names=names)

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; rows that are held out are never
    learnt from. Further columns of either table are ignored, repeated rows score alike."""
    space = train(docs, labels, ~held_out(3, 1))
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), space)
    return rows.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
