"""Splitting oversized texts (problem 3): the fixed-window rule, and content-defined chunking."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.chunking import SPACE, spans

LIMIT, OVERLAP = 1200, 200
#: Content-defined cuts: landmarks are placed by the hash of WINDOW characters, one in RATE positions on average.
WINDOW, RATE, MINIMUM = 32, 256, 300
#: A landmark moves to a natural boundary at most this far away.
SNAP = 120

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def landmarks(text: str) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW characters hits 0 modulo RATE.

    The hash is a polynomial modulo 2**64 from prefix sums, so each position depends on its WINDOW characters only.
    """
    n = len(text)
    if n < WINDOW:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
        down = np.multiply.accumulate(np.full(n, _INVERSE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * down, dtype=np.uint64)])
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * up[WINDOW - 1 :]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((rolled >> np.uint64(32)) % np.uint64(RATE) == 0) + WINDOW


_KINDS = [re.compile("\\n"), re.compile(f"[.!?](?={SPACE}|\\Z)"), re.compile(SPACE)]


def _nearest(cuts: list[list[int]], at: int, low: int, high: int) -> int | None:
    """The boundary nearest to ``at`` in [low, high], of the strongest kind that has one there."""
    for kind in cuts:
        k = bisect_left(kind, at)
        near = [c for c in kind[max(0, k - 1) : k + 1] if low <= c <= high]
        if near:
            return min(near, key=lambda c: (abs(c - at), c))
    return None


def content_spans(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """The (start, end) of content-defined pieces, together covering the text, each at most ``limit`` long.

    Cores run from cut to cut; a cut is the first landmark at least MINIMUM after the last cut, moved to the nearest
    natural boundary within SNAP, or failing a landmark the last boundary that the size allows. A piece is its core
    and up to ``overlap`` characters before it, from a white space on. Cuts depend on the characters around them and
    on the cut before, and fall back into step at the next common landmark: an edit alters neighbouring pieces only.
    A null, empty or blank text has no pieces.
    """
    text = text or ""
    if not text.strip():
        return
    n, core = len(text), max(1, limit - overlap)
    least = max(1, min(MINIMUM, core // 2))
    marks = landmarks(text).tolist()
    cuts = [[m.end() for m in p.finditer(text)] for p in _KINDS]
    at, first = 0, True
    while at < n:
        high = min(n, at + core)
        if high == n:
            end = n
        else:
            k = bisect_left(marks, at + least)
            mark = marks[k] if k < len(marks) and marks[k] <= high else None
            if mark is not None:
                end = _nearest(cuts, mark, max(at + least, mark - SNAP), min(high, mark + SNAP)) or mark
            else:
                end = _nearest(cuts, high, at + least, high) or high
        start = at
        if not first and overlap:
            spaces = cuts[2]
            k = bisect_left(spaces, at - overlap)
            start = spaces[k] if k < len(spaces) and spaces[k] <= at else at - overlap
            start = max(0, start)
        yield start, end
        at, first = end, False


def _cut_table(texts: DataFrame, cut, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, a, b) for k, t in zip(batch["resource_id"], batch["text"], strict=True) for i, (a, b) in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=["resource_id", "piece_index", "char_start", "char_end"])

    return texts.mapInPandas(run, schema)


_SCHEMA = "resource_id string, piece_index int, char_start int, char_end int"


def window_pieces(resource_text: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows (resource_id, piece_index, char_start, char_end): the fixed-window pieces of every ok text above ``limit``.

    Nulls and texts that are not ok have no pieces; an empty table gives none; repeated deliveries count once: the
    pieces are made where the text lies and equal rows dropped afterwards, so no text is shuffled.
    """
    ok = resource_text.where((F.col("status") == "ok") & (F.char_length("text") > limit)).select("resource_id", "text")
    return _cut_table(ok, lambda t: spans(t, limit, overlap), _SCHEMA).distinct()


def content_pieces(resource_text: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """As :func:`window_pieces`, with content-defined cuts."""
    ok = resource_text.where((F.col("status") == "ok") & (F.char_length("text") > limit)).select("resource_id", "text")
    return _cut_table(ok, lambda t: content_spans(t, limit, overlap), _SCHEMA).distinct()
