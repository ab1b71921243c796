"""Turning texts into vectors, and vectors into bytes and back.

``hashed`` is a stand-in for a model that needs no download: it makes equal words equal
coordinates. Anything that adds a ``vector`` column to a frame can take its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text

DIM = 256


def hashed(rows: DataFrame, source: Column, dim: int = DIM) -> DataFrame:
    """``rows`` with ``vector``: hashed counts of the words and identifier parts of ``source``, at length one; a text without words is all zero."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = lru_cache(maxsize=200_000)(lambda word: int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim)
        for words in batches:
            out = []
            for own in words:
                counts = np.bincount([place(w) for w in own], minlength=dim).astype(float) if len(own) else np.zeros(dim)
                out.append(counts / max(np.sqrt(counts @ counts), 1e-300))
            yield pd.Series(out)

    return rows.withColumn("vector", counted(text.words(text.symbol_text(source))))


@F.pandas_udf(T.BinaryType())
def encoded(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decoded(blobs: pd.Series) -> pd.Series:
    """The vector of a blob; null, or a length that is no multiple of four, gives null."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())
