"""Vector expressions.  Sums are in double, in the order of the elements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """``v`` at unit length; a zero vector comes out as it is, null stays null."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def usable(v: Column, dim: int) -> Column:
    """Whether ``v`` has ``dim`` numbers, not all of them zero; false for null."""
    return F.coalesce((F.size(v) == dim) & ((F.array_max(v) != 0) | (F.array_min(v) != 0)), F.lit(False))


@F.pandas_udf(BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian 4-byte floats, one after the other; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """The vectors of such blobs; a length that is no multiple of 4 raises an error."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))
