"""Hashed phrase embeddings and cosine distance."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIM = 384


@lru_cache(maxsize=200_000)
def _slot(feature: bytes, dim: int) -> tuple[int, int]:
    h = 0xCBF29CE484222325
    for byte in feature:
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h % dim, -1 if h & 1 else 1


def embed(words: list[str], dim: int = DIM) -> list[float] | None:
    """The unit vector of a text's content words: distinct words and distinct neighbours, hashed with a sign."""
    features = {b"u:" + w.encode() for w in words}
    features |= {b"b:" + a.encode() + b"\0" + b.encode() for a, b in zip(words, words[1:], strict=False) if a != b}
    if not features:
        return None
    out = np.zeros(dim, np.float32)
    for f in features:
        at, sign = _slot(f, dim)
        out[at] += sign
    norm = np.float32(np.sqrt((out.astype(np.float64) ** 2).sum()))
    return (out / norm).tolist() if norm else None


@F.pandas_udf(ArrayType(FloatType()))
def embed_words(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else embed(list(w)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine, in double precision, inside the JVM."""
    return F.lit(1.0) - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
