"""Distances, scores and the hash embedding as column expressions."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.paths import col

DIMS = 256
_TOKEN = re.compile(r"[A-Za-z0-9_]+")


def l2(a: Column | str, b: Column | str) -> Column:
    """Squared distance in double precision; null where the lengths differ."""
    d = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.size(col(a)) == F.size(col(b)), d)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for a vector of zeros; null where the lengths differ."""
    c = dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    return F.when(F.size(col(a)) == F.size(col(b)), F.coalesce(c, F.lit(0.0)))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def score(distance: Column | str) -> Column:
    """Similarity of unit vectors from their squared distance."""
    return clamp(F.lit(1.0) - col(distance) / 2)


def _token_vector(token: str) -> np.ndarray:
    raw = b"".join(hashlib.sha256(token.encode() + struct.pack(">I", i)).digest() for i in range(DIMS // 8))
    return np.frombuffer(raw, ">u4").astype(np.float64) / 0xFFFFFFFF * 2 - 1


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sum of the token vectors (with repetition), of length 1; null for null. Tokens seen before are looked up."""
    seen: dict[str, np.ndarray] = {}

    def embed(t: str | None) -> list[float] | None:
        if t is None:
            return None
        total = np.zeros(DIMS)
        for w in _TOKEN.findall(t.lower()) or [t.lower()]:
            if w not in seen:
                seen[w] = _token_vector(w)
            total += seen[w]
        n = np.linalg.norm(total)
        return (total / n if n else total).tolist()

    for s in texts:
        yield s.map(embed)
        if len(seen) > 200_000:
            seen.clear()
