"""Vector expressions on array columns, and the little-endian float codec."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; of different lengths the shorter counts."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has norm 0."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def normalised(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def truncated(a: Column, size: int) -> Column:
    """The first values, at length one: a shorter embedding out of a nested one."""
    return normalised(F.slice(a, 1, size))


def mean_pooled(states: Column, mask: Column) -> Column:
    """Mean of the token states whose mask is 1; a short mask leaves the rest out; nothing left gives zeros."""
    size = F.size(states[0])
    used = F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda x: x["m"] == 1)
    zero = F.transform(states[0], lambda _: F.lit(0.0))
    total = F.aggregate(used, zero, lambda s, x: F.zip_with(s, x["s"], lambda u, v: u + v.cast("double")))
    return F.when((size > 0) & (F.size(used) > 0), F.transform(total, lambda x: x / F.size(used))).otherwise(zero)


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a vector."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """The vector of a blob; a length that is no multiple of four is an error."""

    def read(b: bytes | None) -> np.ndarray | None:
        if b is None:
            return None
        if len(b) % 4:
            raise ValueError(f"{len(b)} bytes are no vector of 32-bit floats")
        return np.frombuffer(b, dtype="<f4")

    return blobs.map(read)
