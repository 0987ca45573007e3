"""Byte-level BPE encoders in Python workers, built from a broadcast vocabulary file."""

from __future__ import annotations

import base64
import os

import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Where the vocabulary files lie; every operator takes another path as a parameter.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the id after the last rank, the end-of-text mark.
END_OF_TEXT = 50256

_encoders: dict[bytes, tiktoken.Encoding] = {}


def vocabulary(spark: SparkSession, path: str = BYTE_BPE) -> Broadcast:
    """The file's bytes, read once on the driver (under 1 MB) and broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(raw: bytes) -> tiktoken.Encoding:
    """One encoder a worker process and vocabulary."""
    if raw not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        _encoders[raw] = tiktoken.Encoding("broadcast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[raw]
