"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece can cross (words with their leading spaces, before marks that
never follow a letter inside a piece). The units of all texts are counted. For the frequent ones (the
dictionary: as many as HEAD allows, which bounds what is broadcast) all substrings up to the longest
piece are exploded and equi-joined to the piece table, and the edges are grouped by unit. A fold with
Spark's higher-order `aggregate` then segments the unit: for a unigram model the Viterbi recursion
over end positions, for a BPE model the merges in order of score (a Viterbi path over scores would
not give BPE's result), with the open boundaries as bits of a long.

Documents are encoded by the broadcast dictionary. Units beyond it (words that occur a few times in
the whole corpus) and units of more than FOLD characters (a long has 64 bits, and the fold is
quadratic) take the same segmentation inside the task that meets them: sending each of their
occurrences through a join and back would move more than the texts themselves.
"""

from __future__ import annotations

import heapq
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.scratch import cut
from graphloom.llm.texts import small_batches

MODEL = f"{os.environ.get('TOKENIZERS_DIR', '/opt/tokenizers')}/piece_bpe_32k.model"
HEAD = 200_000
FOLD = 60
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says: pieces with scores, kind and the settings used here."""

    kind: int = UNIGRAM
    prefix: bool = True
    pieces: dict[str, tuple[int, float]] = field(default_factory=dict)
    bytes_: list[int] = field(default_factory=lambda: [-1] * 256)
    unknown: int = 0
    texts: list[str] = field(default_factory=list)
    marks: str = ""

    @cached_property
    def scores(self) -> dict[str, float]:
        return {p: s for p, (_, s) in self.pieces.items()}

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def least(self) -> float:
        return min((score for _, score in self.pieces.values()), default=0.0)


def read_model(path: str = MODEL) -> Model:
    """Reads a SentencePiece model of kind unigram or BPE with the identity normalisation, which keeps
    runs of spaces. Other normalisations and user-defined pieces raise ValueError."""
    model = Model()
    with open(path, "rb") as f:
        raw = f.read()
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            text, kind, at = piece.get(1, b"").decode().replace(SPACE, " "), piece.get(3, NORMAL), len(model.texts)
            model.texts.append(text)
            if kind == NORMAL:
                model.pieces[text] = (at, float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
            elif kind == BYTE:
                model.bytes_[int(text[1:-1], 16)] = at
            elif kind == UNKNOWN:
                model.unknown = at
            elif kind == 4:
                raise ValueError("user-defined pieces are not supported")
        elif number == 2:
            model.kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            model.prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("only the identity normalisation that keeps spaces is supported")
    if any(re.search("[^ ] |\n.|.\n", p, re.S) for p in model.pieces):
        raise ValueError("pieces that cross words are not supported")
    after = {c for p in model.pieces for a, c in zip(p, p[1:]) if regex.match(r"\p{L}", a)}
    model.marks = "".join(c for c in "!\"#$%&()*+,./:;<=>?@[]^_`{|}~" if c not in after)
    return model


_WORDS = re.compile(" *[^ \n]+| +|\n")


def words_of(text: str | None, prefix: bool) -> list[str]:
    """Words with their leading spaces; the mark that stands for a space counts as one. Empty strings may
    stand between words."""
    if not text:
        return []
    text = (" " if prefix else "") + (text.replace(SPACE, " ") if SPACE in text else text)
    if "  " in text or "\0" in text:
        return _WORDS.findall(text)
    # The common case, without the regular expression.
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class Cutter:
    """Cuts a word into its units: before a mark that follows a letter."""

    def __init__(self, marks: str):
        self.at = regex.compile(rf"(?<=\p{{L}})(?=[{regex.escape(marks)}])", regex.V1) if marks else None

    def __call__(self, word: str) -> list[str]:
        if self.at is None or word.lstrip(" ").isalpha():
            return [word]
        return [x for x in self.at.split(word) if x]


def _merged(unit: str, scores: dict[str, float]) -> list[str]:
    """BPE of a short unit: the best-scored neighbours merge, the leftmost on ties."""
    parts, get, none = list(unit), scores.get, -np.inf
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = max(pairs)
        if best == none:
            break
        k = pairs.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del pairs[k]
        if k < len(pairs):
            pairs[k] = get(parts[k] + parts[k + 1], none)
        if k:
            pairs[k - 1] = get(parts[k - 1] + parts[k], none)
    return parts


def _merged_long(unit: str, scores: dict[str, float]) -> list[str]:
    """The same for units of any length, with a heap of candidates."""
    parts: list[str | None] = list(unit)
    follow = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(a: int, b: int) -> None:
        if 0 <= a and b < len(parts) and parts[a] + parts[b] in scores:
            heapq.heappush(heap, (-scores[parts[a] + parts[b]], a, b, parts[a] + parts[b]))

    for a in range(len(parts) - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, joined = heapq.heappop(heap)
        if parts[a] is None or parts[b] is None or follow[a] != b or parts[a] + parts[b] != joined:
            continue
        parts[a], parts[b], follow[a] = joined, None, follow[b]
        if follow[a] < len(parts):
            before[follow[a]] = a
        offer(before[a], a)
        offer(a, follow[a])
    return [p for p in parts if p is not None]


def segment(unit: str, model: Model) -> list[int]:
    """The ids of one unit, in a task: for units beyond the dictionary or too long for the fold."""
    if model.kind == BPE:
        found = (_merged if len(unit) <= FOLD else _merged_long)(unit, model.scores)
    else:
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-np.inf, 0)] * len(unit)
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - model.longest), end):
                piece = model.pieces.get(unit[start:end])
                score = piece[1] if piece else model.least - 10 if end - start == 1 else None
                if score is not None and best[start][0] + score > best[end][0]:
                    best[end] = (best[start][0] + score, start)
        found, end = [], len(unit)
        while end:
            found.insert(0, unit[best[end][1] : end])
            end = best[end][1]
    pieces = model.pieces
    if all(p in pieces for p in found):
        return [pieces[p][0] for p in found]
    spell = lambda c: [model.bytes_[b] for b in c.encode()] if model.bytes_[0] >= 0 else [model.unknown]
    return [i for p in found for i in ([pieces[p][0]] if p in pieces else spell(p))]


def count_units(docs: DataFrame, model: Broadcast) -> DataFrame:
    """unit, n over all texts, pre-aggregated in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, words = Cutter(model.value.marks), Counter()

        def flush() -> pa.RecordBatch:
            units: dict[str, int] = {}
            words.pop("", None)
            for word, n in words.items():
                for unit in cutter(word):
                    units[unit] = units.get(unit, 0) + n
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(units.keys(), pa.string()), pa.array(units.values(), pa.int64())], names=["unit", "n"])

        for batch in small_batches(batches, 200):
            for text in batch.column(0).to_pylist():
                words.update(words_of(text, model.value.prefix))
            if len(words) > 200_000:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """unit -> with edges: array of (cost, start, end, id), best score first, then by start. Units are
    dealt by hash once; the edges of a unit are made and grouped where the unit lies."""
    starts = units.repartition("unit").select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    spans = starts.select("unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("unit") - F.col("s")))).alias("l"))
    substrings = spans.withColumn("piece", F.col("unit").substr(F.col("s") + 1, F.col("l")))
    edges = substrings.join(F.broadcast(pieces), "piece", "left").where("id is not null or l = 1")
    edge = F.struct((-F.col("score")).alias("cost"), "s", (F.col("s") + F.col("l")).alias("e"), "id")
    return edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _bit(n: str) -> str:
    return f"shiftleft(1L, {n})"


def fold_merges() -> str:
    """BPE: open boundaries as bits; each step closes the boundary inside the first edge that spans
    exactly two open parts. Gives the bits that stay open."""
    edges = f"""transform(filter(edges, x -> x.e - x.s > 1), x -> named_struct(
        'ends', {_bit('x.s')} | {_bit('x.e')}, 'inner', {_bit('x.e')} - {_bit('x.s + 1')}))"""
    step = """(open, k) -> open & ~coalesce(try_element_at(filter(spans, x -> (open & x.ends) = x.ends AND bit_count(open & x.inner) = 1), 1).inner, 0L)"""
    return f"""transform(array({edges}), spans -> aggregate(
        sequence(1, greatest(length(unit) - 1, 1)), {_bit('length(unit) + 1')} - 1L, {step}))[0]"""


def fold_viterbi(missing: float) -> str:
    """Unigram: best (score, -start) for each end, then the boundaries on the best path as bits. A
    character without a piece costs `missing`."""
    candidate = f"named_struct('score', best[x.s].score - coalesce(x.cost, {missing}D), 'from', -x.s)"
    best = f"""aggregate(sequence(1, length(unit)), array(named_struct('score', 0.0D, 'from', 0)), (best, k) -> concat(best, array(
        array_max(transform(filter(edges, x -> x.e = k), x -> {candidate})))))"""
    back = f"""aggregate(sequence(1, length(unit)), named_struct('open', {_bit('length(unit)')}, 'at', length(unit)),
        (p, k) -> IF(p.at = 0, p, named_struct('open', p.open | {_bit('-path[p.at].from')}, 'at', -path[p.at].from)), p -> p.open)"""
    return f"transform(array({best}), path -> {back})[0]"


def ids_of(model: Model) -> str:
    """The pieces between open boundaries; characters without a piece become bytes or the unknown id."""
    table = f"array({', '.join(map(str, model.bytes_))})"
    spelled = (
        f"transform(sequence(1, octet_length(substr(unit, b + 1, 1))), o -> {table}[CAST(conv(substr(hex(encode(substr(unit, b + 1, 1), 'UTF-8')), 2 * o - 1, 2), 16, 10) AS INT)])"
        if model.bytes_[0] >= 0
        else f"array({model.unknown})"
    )
    end = f"array_min(filter(sequence(1, length(unit)), c -> c > b AND (open & {_bit('c')}) <> 0))"
    found = f"try_element_at(filter(edges, x -> x.s = b AND x.e = {end} AND x.id IS NOT NULL), 1).id"
    return f"""flatten(transform(filter(sequence(0, length(unit) - 1), b -> (open & {_bit('b')}) <> 0),
        b -> transform(array({found}), i -> IF(i IS NULL, {spelled}, array(i)))[0]))"""


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """Distinct units of 1 to FOLD characters -> unit, ids."""
    pieces = units.sparkSession.createDataFrame([(p, i, float(s)) for p, (i, s) in model.pieces.items()], "piece string, id int, score double")
    folded = fold_merges() if model.kind == BPE else fold_viterbi(10 - model.least)
    return lattice(units, pieces, model.longest).withColumn("open", F.expr(folded)).select("unit", F.expr(ids_of(model)).alias("ids"))


def dictionary(units: DataFrame, model: Model, head: int) -> Broadcast:
    """Broadcasts the ids of the most frequent units (unit, n): all above the count at which no more
    than `head` qualify. An Arrow stream of unit and ids, some ten bytes a unit."""
    # Counts in 64 steps a doubling, so that few thousand rows decide where the head ends.
    short = units.where(F.length("unit").between(1, FOLD)).withColumn("step", F.floor(F.log2("n") * 64).cast("int"))
    steps = short.groupBy("step").agg(F.count(F.lit(1)).alias("units"))
    upto = F.sum("units").over(Window.orderBy(F.desc("step")))
    least = steps.withColumn("upto", upto).where(F.col("upto") <= head).agg(F.min("step")).first()[0]
    frequent = short.where(F.col("step") >= (least if least is not None else 2**31 - 1)).select("unit")
    table = encode_units(frequent, model).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return units.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


class _Encoded(dict):
    """word -> its ids as bytes, from the dictionary or segmented on first use; emptied when full."""

    def __init__(self, model: Model, known: dict[str, bytes]):
        super().__init__()
        self.model, self.known, self.cut = model, known, Cutter(model.marks)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 120_000:
            self.clear()
        parts = []
        for unit in self.cut(word):
            ids = self.known.get(unit)
            parts.append(ids if ids is not None else np.array(segment(unit, self.model), np.int32).tobytes())
        value = self[word] = b"".join(parts)
        return value


def encode(docs: DataFrame, path: str = MODEL, head: int = HEAD) -> DataFrame:
    """doc_id, n_pieces, ids for every row of docs, equal to the library's own encoding of the text.

    A null text has null ids and 0 pieces, an empty one no ids. Repeated rows and null doc_ids are
    encoded like any other; an empty table gives an empty result. Further columns are ignored.
    """
    model = read_model(path)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    head_ids = dictionary(cut(count_units(rows, shared), "units"), model, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, prefix = _Encoded(shared.value, _head(head_ids)), shared.value.prefix
        for batch in small_batches(batches, 200):
            texts = batch.column(1).to_pylist()
            ids = [None if t is None else np.frombuffer(b"".join(map(encoded.__getitem__, words_of(t, prefix))), np.int32) for t in texts]
            sizes = pa.array([0 if x is None else len(x) for x in ids], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_pieces", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pieces int, ids array<int>")


_heads: dict[int, dict[str, bytes]] = {}


def _head(shared: Broadcast) -> dict[str, bytes]:
    """The broadcast units as a dictionary, built once a worker process."""
    raw = shared.value
    if hash(raw) not in _heads:
        _heads.clear()
        found: dict[str, bytes] = {}
        for batch in pa.ipc.open_stream(raw):
            for piece in (batch.slice(at, 10_000) for at in range(0, batch.num_rows, 10_000)):
                ids = piece.column(1)
                flat, ends = ids.flatten().to_numpy(), np.cumsum([0, *[len(x) for x in ids]])
                found.update((u, flat[ends[k] : ends[k + 1]].tobytes()) for k, u in enumerate(piece.column(0).to_pylist()))
        _heads[hash(raw)] = found
    return _heads[hash(raw)]


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded with a column text from its ids: pieces joined, byte pieces as UTF-8, spaces restored.
    Null ids give null. An existing column text is replaced."""
    model = read_model(path)
    is_byte = {i: b for b, i in enumerate(model.bytes_) if i >= 0}
    raw = [bytes([is_byte[i]]) if i in is_byte else t.encode() for i, t in enumerate(model.texts)]
    shared = encoded.sparkSession.sparkContext.broadcast((raw, model.prefix))
    plain = encoded.drop("text")
    at, names = plain.columns.index("ids"), [*plain.columns, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, prefix = shared.value
        pieces = np.array(raw, dtype=object)
        for batch in small_batches(batches, 500):
            ids, texts = batch.column(at), []
            parts = pieces[ids.flatten().to_numpy()].tolist()
            ends = np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()]).tolist()
            for k, known in enumerate(ids.is_valid().to_pylist()):
                text = b"".join(parts[ends[k] : ends[k + 1]]).decode("utf-8", "replace") if known else None
                texts.append(text[1:] if text and prefix and text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    from pyspark.sql.types import StringType, StructField, StructType

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("text", StringType())]))


def round_trip(docs: DataFrame, path: str = MODEL, head: int = HEAD) -> DataFrame:
    """doc_id, n_pieces, ids, and restored: whether the decoded ids give the text back (null for a null
    text). The mark that stands for a space counts as a space, as it does for the library."""
    digest = lambda text: F.xxhash64(F.regexp_replace(text, SPACE, " "))
    hashed = docs.select(F.struct("doc_id", digest("text").alias("h"), F.col("text").isNull().alias("gone")).alias("doc_id"), "text")
    back = decode(encode(hashed, path, head), path)
    restored = F.when(~F.col("doc_id.gone"), digest("text") == F.col("doc_id.h")).alias("restored")
    return back.select(F.col("doc_id.doc_id").alias("doc_id"), "n_pieces", "ids", restored)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, decodes what came out, and says whether the texts came back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
