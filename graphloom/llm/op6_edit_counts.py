"""Token counts that follow edits.

A document's text is cut into leaves of whole pre-tokens at places where encoding either side alone
gives the same tokens as encoding both together. A segment tree over the leaves keeps sums of
characters and tokens. An edit finds its leaves by descending the character sums, takes in a
neighbouring leaf wherever the edit has spoilt the cut to it, re-encodes that region alone and
updates the sums on the paths above it.

The trees are kept: build_trees gives a table with the characters and tokens of every leaf, and
apply_edits reads it, so that later batches of edits encode what they touch and nothing else.
Documents without edits pass through without a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions.scratch import cut
from graphloom.llm import tokens
from graphloom.llm.texts import small_batches

#: Leaves hold at least so many characters (but for the last).
LEAF = 256

#: No pre-token spans these places, whatever stands further left or right: before white space; between
#: letters, digits and marks, but for an apostrophe before a letter, which may be a contraction.
_CUT = regex.compile(
    r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])"
    r"|(?<=[\p{P}\p{S}])(?=\p{N})|(?<=[\p{P}\p{S}--'])(?=\p{L})",
    regex.V1,
)


def cut_leaves(text: str, size: int = LEAF) -> list[str]:
    """Leaves of at least size characters that can be encoded one by one. A run of letters alone, however
    long, is one pre-token and stays in one leaf."""
    leaves, start = [], 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if not found:
            break
        leaves.append(text[start : found.start()])
        start = found.start()
    return [*leaves, text[start:]]


class CountTree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, text: str, encode: tiktoken.Encoding, counts: list[int] | None = None, leaves: list[str] | None = None):
        self.encode = encode
        self.leaves = leaves if leaves is not None else cut_leaves(text)
        counts = counts if counts is not None else [len(encode.encode_ordinary(x)) for x in self.leaves]
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for k, (leaf, n) in enumerate(zip(self.leaves, counts)):
            self.chars[self.width + k], self.tokens[self.width + k] = len(leaf), n
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, offset in it) of a position; the end belongs to the last leaf."""
        if at >= self.chars[1]:
            return len(self.leaves) - 1, len(self.leaves[-1]) + at - self.chars[1]
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def edit(self, at: int, removed: int, inserted: str) -> int:
        """Replaces removed characters from at by inserted; positions beyond the text are moved to its
        end. Returns how many characters were encoded again."""
        at = min(max(at, 0), self.chars[1])
        removed = min(max(removed, 0), self.chars[1] - at)
        if not removed and not inserted:
            return 0
        first, offset = self.find(at)
        last = self.find(at + removed)[0]
        region = "".join(self.leaves[first : last + 1])
        region = region[:offset] + inserted + region[offset + removed :]
        # Boundary context: the cut to either neighbour must still be one.
        while first > 0 and not self._parts(self.leaves[first - 1], region):
            first -= 1
            region = self.leaves[first] + region
        while last < len(self.leaves) - 1 and not self._parts(region, self.leaves[last + 1]):
            last += 1
            region += self.leaves[last]
        slots = last - first + 1
        pieces = cut_leaves(region)
        counts = [len(self.encode.encode_ordinary(x)) for x in pieces]
        if len(pieces) > slots:  # the region grew: new sums over the known leaves, nothing else is encoded
            known = self.tokens[self.width : self.width + len(self.leaves)]
            leaves = [*self.leaves[:first], *pieces, *self.leaves[last + 1 :]]
            self.__init__("", self.encode, [*known[:first], *counts, *known[last + 1 :]], leaves)
            return len(region)
        pieces += [""] * (slots - len(pieces))
        counts += [0] * (slots - len(counts))
        nodes = set()
        for k in range(slots):
            self.leaves[first + k] = pieces[k]
            node = self.width + first + k
            self.chars[node], self.tokens[node] = len(pieces[k]), counts[k]
            nodes.add(node // 2)
        while nodes and self.width > 1:
            for node in nodes:
                self._sum(node)
            nodes = {node // 2 for node in nodes if node > 1}
        return len(region)

    @staticmethod
    def _parts(left: str, right: str) -> bool:
        """Whether the place between two leaves is a cut; next to an empty leaf it is not one."""
        return bool(left and right and _CUT.match(left[-1] + right[0], 1))


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with a column edits: array of (seq, at, removed, inserted) from a table of edits with
    doc_id, in order of seq. Edits of one document are applied one after the other, so they meet in
    one row; documents without edits have null."""
    step = F.struct("seq", "at", "removed", "inserted")
    per = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_list(step)).alias("edits"))
    return docs.drop("edits").join(per, "doc_id", "left")


_LEAVES = "chars array<int>, tokens array<int>"


def build_trees(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """docs with columns chars and tokens: arrays with the characters and tokens of every leaf of `text`,
    in order. Every text is encoded once, whole; a null text has one empty leaf. All other columns pass
    through (but for earlier ones of these names), repeated rows too; an empty table stays empty."""
    rows = docs.drop("chars", "tokens")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary.value)
        for batch in small_batches(batches, 256):
            leaves = [cut_leaves(t or "") for t in batch.column(at).to_pylist()]
            chars = [[len(x) for x in ls] for ls in leaves]
            counts = [[len(encode.encode_ordinary(x)) for x in ls] for ls in leaves]
            made = [pa.array(c, pa.list_(pa.int32())) for c in (chars, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "chars", "tokens"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(_LEAVES).fields]))


def apply_edits(trees: DataFrame, vocabulary: Broadcast, edits: str = "edits") -> DataFrame:
    """A table of trees with the edits of each row applied: text, chars and tokens are brought up to
    date, the column of edits is gone, and n_tokens_before, n_tokens and n_encoded (characters encoded
    for the edits) are added.

    Edits are arrays of structs with at, removed and inserted, by position in characters of the text as
    the earlier edits left it; null edits or parts of them count as none. Rows without edits keep their
    counts and are neither encoded nor sent to a Python worker. Existing columns of the three names are
    replaced."""
    fresh = ["n_tokens_before", "n_tokens", "n_encoded"]
    rows = trees.drop(*fresh)
    kept = [c for c in rows.columns if c != edits]
    known = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    has = F.coalesce(F.size(edits) > 0, F.lit(False))
    untouched = rows.where(~has).select(*kept, known.alias("n_tokens_before"), known.alias("n_tokens"), F.lit(0).cast("long").alias("n_encoded"))
    touched = rows.where(has).select(*kept, edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary.value)
        for batch in small_batches(batches, 256):
            column = dict(zip(batch.schema.names, batch.columns))
            texts, out = [], [[], [], [], [], []]
            for text, chars, counts, steps in zip(*(column[c].to_pylist() for c in ("text", "chars", "tokens", edits))):
                ends = [0, *accumulate(chars)]
                tree = CountTree("", encode, counts, [(text or "")[a:b] for a, b in pairwise(ends)])
                before, again = tree.total, 0
                for step in steps:
                    if step:
                        again += tree.edit(step["at"] or 0, step["removed"] or 0, step["inserted"] or "")
                filled = [(len(x), n) for x, n in zip(tree.leaves, tree.tokens[tree.width :]) if x] or [(0, 0)]
                texts.append("".join(tree.leaves) if again else text)
                for values, value in zip(out, ([c for c, _ in filled], [n for _, n in filled], before, tree.total, again)):
                    values.append(value)
            column |= {"text": pa.array(texts, pa.string())}
            column |= {n: pa.array(v, pa.list_(pa.int32())) for n, v in zip(("chars", "tokens"), out)}
            made = [pa.array(v, pa.int64()) for v in out[2:]]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in kept), *made], names=[*kept, *fresh])

    return untouched.unionByName(touched.mapInArrow(run, untouched.schema))


def count_with_edits(docs: DataFrame, edits: Column, vocabulary: Broadcast) -> DataFrame:
    """doc_id, n_tokens (before), n_tokens_after (the edits in order), n_leaves, n_encoded (characters
    encoded again) for every row of docs: the trees are built and kept as a table, then the edits are
    applied to that table.

    A null text counts as empty and can be edited. Repeated rows are counted alike; further columns are
    ignored. An empty table gives an empty result.
    """
    trees = cut(build_trees(docs.select("doc_id", "text", edits.alias("edits")), vocabulary), "trees")
    return apply_edits(trees, vocabulary).select(
        "doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), F.size("tokens").cast("long").alias("n_leaves"), "n_encoded"
    )


def revision(text: Column) -> Column:
    """The edits of the registered query: a note a third of the way in, forty characters out after two
    thirds, a line at the end."""
    size = F.coalesce(F.length(text), F.lit(0))
    step = lambda at, removed, inserted: F.struct(at.cast("int").alias("at"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    return F.array(step(size / 3, 0, " (revised)"), step(2 * size / 3, 40, ""), step(size, 0, "\nEnd of revision 2."))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_with_edits(docs, revision(F.col("text")), tokens.vocabulary(spark))
