"""Vectors: similarity as Column expressions, and the encodings that need NumPy as pandas UDFs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, undefined: float = 0.0) -> Column:
    """Cosine similarity; ``undefined`` for unlike lengths, nulls and zero vectors."""
    d = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (d > 0), dot(a, b) / d), F.lit(undefined))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def running_centroid(vectors: Column) -> Column:
    """Fold of the mean of the last centroid and each next vector: late vectors weigh more."""
    return F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.get(vectors, 0).cast("array<double>"), lambda c, v: F.zip_with(c, v, lambda x, y: (x + y.cast("double")) / 2))


@F.pandas_udf(ArrayType(FloatType()))
def decode_float32(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(BinaryType())
def encode_float32(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def _seed(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@F.pandas_udf(ArrayType(FloatType()))
def stub_embedding(texts: pd.Series) -> pd.Series:
    """A repeatable stand-in for an embedding model: unit vectors of 384 dimensions seeded by the text's MD5."""

    def one(text: str | None):
        if text is None:
            return None
        v = np.random.RandomState(_seed(text)).randn(384).astype(np.float32)
        return v / np.linalg.norm(v)

    return texts.map(one)
