"""Encoding with a public byte-level BPE tokenizer (problem 8), as a monoid of partly encoded texts.

The pre-tokenizer never joins a word character with a following blank or line break, so a position between the two is
a token boundary whatever stands around it. A stretch of text is encoded as (head, ids, tail): the ids between its
first and last such position, which no context can change, and the unsettled text on either side. Joining two
neighbours re-encodes only ``left.tail + right.head``; where that window has no settled position the text grows, up to
the whole. The join is associative, so halves are encoded recursively and joined up the tree, and a text's ids are
exactly those of encoding it at once.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabulary files lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts up to this many characters are encoded at once.
LEAF = 1 << 15

# Fixed value: the pre-tokenizer's pattern, which the ids depend on.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SETTLED = re.compile(r"(?<=\w)(?=[ \n])")
_ENCODERS: dict[str, Callable[[str], list[int]]] = {}
_PIECES: dict[str, dict[int, bytes]] = {}


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pieces_of(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> dict[int, bytes]:
    """The bytes of each id of a vocabulary file, loaded once in each Python worker."""
    path = os.path.join(folder, vocabulary)
    if path not in _PIECES:
        _PIECES[path] = {rank: token for token, rank in _ranks(path).items()}
    return _PIECES[path]


def decode_tree(ids: list[int], pieces: dict[int, bytes], leaf: int = 1 << 12) -> bytes:
    """The bytes of ``ids``: halves are decoded for themselves and concatenated up the tree."""
    if len(ids) <= leaf:
        return b"".join(map(pieces.__getitem__, ids))
    middle = len(ids) // 2
    return decode_tree(ids[:middle], pieces, leaf) + decode_tree(ids[middle:], pieces, leaf)


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    """The plain encoder of a vocabulary file, loaded once in each Python worker."""
    path = os.path.join(folder, vocabulary)
    if path not in _ENCODERS:
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={}).encode_ordinary
    return _ENCODERS[path]


@dataclass(frozen=True)
class Part:
    """A stretch of text, partly encoded; ``ids`` is None while it has no settled position (all text is in head)."""

    head: str
    ids: tuple[list[int], ...] | None = None
    tail: str = ""

    def join(self, right: Part, encode: Callable[[str], list[int]]) -> Part:
        if self.ids is None and right.ids is None:
            return part(self.head + right.head, encode)
        if self.ids is None:
            return Part(self.head + right.head, right.ids, right.tail)
        if right.ids is None:
            return Part(self.head, self.ids, self.tail + right.head)
        return Part(self.head, (*self.ids, encode(self.tail + right.head), *right.ids), right.tail)


def part(text: str, encode: Callable[[str], list[int]]) -> Part:
    """``text`` as a Part, encoded between its first and last settled positions."""
    first = _SETTLED.search(text)
    if first is None:
        return Part(text)
    start, end = first.start(), max(text.rfind(" "), text.rfind("\n"))
    while not _SETTLED.match(text, end):
        end = max(text.rfind(" ", start, end), text.rfind("\n", start, end))
    return Part(text[:start], (encode(text[start:end]) if end > start else [],), text[end:])


def encode_tree(text: str, encode: Callable[[str], list[int]], leaf: int = LEAF) -> list[int]:
    """The ids of ``text`` by tree reduction; equal to ``encode(text)`` for every ``leaf``."""

    def reduce(low: int, high: int) -> Part:
        if high - low <= leaf:
            return part(text[low:high], encode)
        middle = (low + high) // 2
        return reduce(low, middle).join(reduce(middle, high), encode)

    if len(text) <= leaf:
        return encode(text)
    whole = reduce(0, len(text))
    if whole.ids is None:
        return encode(whole.head)
    return [*encode(whole.head), *(i for ids in whole.ids for i in ids), *encode(whole.tail)]


def token_ids(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Rows (key, ids array<int>): the ids of each row's text; an empty list for an empty or null text.

    One row for each row of ``df``, null keys too. Narrow: no shuffle; Arrow batches in and out.
    """
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary)
        for batch in batches:
            lists = [encode_tree(t, encode, leaf) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    out = df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def decoded(df: DataFrame, key: str, ids: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (key, text): the text of each row's ids; an empty text for an empty or null list, bytes that are no UTF-8 replaced."""
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(folder, vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_tree(x or [], pieces).decode("utf-8", "replace") for x in batch.column(1).to_pylist()], pa.string())], names=["key", "text"])

    return df.selectExpr(f"`{key}` as key", f"`{ids}` as ids").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Rows (key, n): the number of ids of each text, 0 for an empty or null one."""
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary)
        for batch in batches:
            counts = [len(encode_tree(t, encode, leaf)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["key", "n"])

    out = df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, f"key {kind}, n bigint")
    return out.withColumnRenamed("key", key)
