"""Vectors: hashed test embeddings, norms and cosines."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT

_OFFSET, _PRIME = 0x811C9DC5, 0x01000193  # fixed values of the 32-bit FNV-1a hash


@functools.lru_cache(1 << 16)
def _fnv1a(token: str) -> int:
    h = _OFFSET
    units = token.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(units), 2):
        h = ((h ^ (units[k] | units[k + 1] << 8)) * _PRIME) & 0xFFFFFFFF
    return h


def hash_embedding(text: str | None, width: int = DEFAULT.embed_width) -> np.ndarray:
    """A unit vector of signed token counts by hash; a text without tokens, null too, is the first unit vector."""
    out = np.zeros(width)
    for token in re.findall(r"[^\W_]+", (text or "").lower()):
        h = _fnv1a(token)
        out[h % width] += 1.0 if h & 1 else -1.0
    norm = float(np.linalg.norm(out))
    if norm == 0:
        out[0], norm = 1.0, 1.0
    return (out / norm).astype(np.float32)


def hash_embed(width: int = DEFAULT.embed_width):
    """The hash embedder as a pandas UDF string -> array<float>; a real model takes its place with the same signature."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: hash_embedding(t if isinstance(t, str) else None, width))

    return embed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, null if a norm is 0 or a side is null."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
