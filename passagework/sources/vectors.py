"""Codec of stored vectors: packed little-endian float32, and JSON arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def from_text(text: Column) -> Column:
    """array<float> of a JSON array; null if it isn't one, or holds something else than numbers."""
    read = F.from_json(text, "array<double>")
    sound = F.startswith(F.btrim(text), F.lit("[")) & F.endswith(F.btrim(text), F.lit("]")) & ~F.exists(read, lambda x: x.isNull())
    return F.when(sound, F.transform(read, lambda x: x.cast("float")))


@F.pandas_udf(BinaryType())
def _packed(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def _unpacked(v: pd.Series) -> pd.Series:
    return v.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))


def pack(vector: Column) -> Column:
    """Packed form of array<float>; null stays null."""
    return _packed(vector)


def unpack(blob: Column) -> Column:
    """array<float> of a packed vector; null for null and for bytes that are no whole number of values."""
    return _unpacked(blob)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
