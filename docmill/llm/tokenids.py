"""Problem 6: encoding a whole corpus with a public byte-level BPE tokenizer.

Method: the tiktoken library with a local rank file; long texts are first cut at places where the tokenizer's own
pattern always starts a new match, so that the ids are those of the whole text; decoding works on raw bytes.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of the byte_bpe_50k vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this many characters are encoded in parts of about this size.
PART = 1 << 16
#: A single space between two other characters that aren't white space: a match always ends before it.
SAFE = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(4)
def encoder(path: str = RANKS):
    """The encoder of a rank file; made once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of a text, cut at safe places only; a text without any stays whole."""
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(text: str | None, path: str = RANKS, size: int = PART) -> np.ndarray:
    """Ids of a text without special tokens; none for an empty or null text."""
    if not text:
        return np.empty(0, np.uint32)
    code = encoder(path)
    if len(text) <= size:
        return code.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([code.encode_to_numpy(x, disallowed_special=()) for x in parts(text, size)])


def decode(ids, path: str = RANKS) -> str:
    """The text of ids, by way of their bytes, so that characters cut between ids are whole again."""
    return encoder(path).decode_bytes(list(ids)).decode("utf-8", "strict")


def _run(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [encode(x.as_py(), path) for x in batch.column(1)]
        ends = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=ends[1:])
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=["_key", "ids"])


def token_ids(df: DataFrame, key: str, text: str, path: str = RANKS) -> DataFrame:
    """key and ids (array<int>) of every row; an empty list for an empty and for a null text.

    Every row of df gives one row, repeats and null keys too. `path` must be readable on every executor. A narrow
    pass: no shuffle, whatever the size of the texts.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _run(it, path), f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def token_text(df: DataFrame, key: str, ids: str, path: str = RANKS) -> DataFrame:
    """key and text of every row of ids; the inverse of token_ids but for null texts, which come back empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x.as_py() or (), path) for x in batch.column(1)], pa.string())], names=["_key", "text"])

    rows = df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)
