"""Fixed-window chunking with cuts snapped to natural boundaries, in Unicode characters."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# The defaults and the characters that the format counts as white space.
MAX_CHARS, OVERLAP_CHARS = 1200, 200
SPACE = "[\\t\\n\\v\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"

_SPACE_RUN = re.compile(f"{SPACE}*")
_LINE_END = re.compile("\\n")
_SENTENCE_END = re.compile(f"[.!?](?={SPACE}|\\Z)")
_WORD_END = re.compile(SPACE)


class Boundaries:
    """Cut positions of a text by strength: after line breaks, sentence ends and white space."""

    def __init__(self, text: str) -> None:
        self.ranks = [[m.end() for m in p.finditer(text)] for p in (_LINE_END, _SENTENCE_END, _WORD_END)]

    def last_in(self, low: int, high: int) -> int | None:
        """The last cut in ``(low, high]`` of the strongest kind that has one there."""
        for cuts in self.ranks:
            k = bisect_right(cuts, high) - 1
            if k >= 0 and cuts[k] > low:
                return cuts[k]
        return None


def spans(text: str | None, max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS) -> Iterator[tuple[int, int]]:
    """The (start, end) of each chunk of ``text``; none for a null, empty or blank text.

    Pieces are at most ``max(1, max_chars)`` long. A cut before the text's end goes to the last boundary of the
    strongest kind in the upper half of the window, white space at a piece's edges is left out, and the next piece
    starts ``overlap_chars`` (below the limit) before the cut, or at the cut if that would not advance.
    """
    text = text or ""
    limit = max(1, max_chars)
    overlap = max(0, min(overlap_chars, limit - 1))
    length, cuts = len(text), Boundaries(text)
    at = _SPACE_RUN.match(text).end()
    while at < length:
        cut = min(at + limit, length)
        if cut < length:
            cut = cuts.last_in(at + max(1, (cut - at) // 2), cut) or cut
        end = cut
        while end > at and _WORD_END.match(text, end - 1):
            end -= 1
        if end > at:
            yield at, end
        if cut >= length:
            return
        back = cut - overlap
        at = max(at + 1, _SPACE_RUN.match(text, back if back > at else cut).end())


def chunk_table(df: DataFrame, key: str, text: str, max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Rows (key, piece_index, char_start, char_end, piece) of each text; other columns of ``df`` are not read."""
    kind = dict(df.dtypes)[key]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, a, b, t[a:b]) for k, t in zip(batch["key"], batch["text"], strict=True) if isinstance(t, str) for n, (a, b) in enumerate(spans(t, max_chars, overlap_chars))]
            yield pd.DataFrame(rows, columns=["key", "piece_index", "char_start", "char_end", "piece"])

    source = df.selectExpr(f"`{key}` as key", f"`{text}` as text")
    return source.mapInPandas(cut, f"key {kind}, piece_index int, char_start int, char_end int, piece string")
