"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(x)) for x in values))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def dimension(v: Column) -> Column:
    """Number of values; null of null."""
    return F.when(v.isNotNull(), F.size(v))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if their lengths differ or one has no norm; null if one is null."""
    norms = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance over the dimensions that both vectors have."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def distance_to_score(distance: Column, cosine: bool = True) -> Column:
    """1 - d of a cosine distance, 1 / (1 + d) of a squared distance."""
    return 1.0 - distance if cosine else 1.0 / (1.0 + distance)


def normalize(v: Column) -> Column:
    """The vector at length 1; a vector without a norm unchanged."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def quantize(v: Column, low: Column, high: Column) -> Column:
    """8-bit codes (array<int>) of a vector between the bounds of each dimension, saturating."""
    ranged = F.zip_with(low, high, lambda lo, hi: F.struct(lo.alias("lo"), (hi - lo).alias("range")))
    return F.zip_with(
        v,
        ranged,
        lambda x, r: F.when(r["range"] <= 0, F.lit(0)).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), F.round((x.cast("double") - r["lo"]) / r["range"] * 255).cast("int")))),
    )


def dequantize(codes: Column, low: Column, high: Column) -> Column:
    """Values of 8-bit codes; an error if the number of codes isn't the number of dimensions."""
    ranged = F.zip_with(low, high, lambda lo, hi: F.struct(lo.alias("lo"), (hi - lo).alias("range")))
    checked = F.when(codes.isNull() | (F.size(codes) == F.size(low)), codes).otherwise(F.raise_error(F.lit("codes and bounds differ in length")).cast("array<int>"))
    return F.zip_with(checked, ranged, lambda c, r: c / F.lit(255.0) * r["range"] + r["lo"])


def check_dimension(v: Column, dim: int) -> Column:
    """The vector itself; an error where it hasn't ``dim`` values."""
    return F.when(v.isNull() | (F.size(v) == dim), v).otherwise(F.raise_error(F.format_string("expected %d values, found %d", F.lit(dim), F.size(v))))


@F.pandas_udf(T.BinaryType())
def to_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian 32-bit floats of a vector; null of null."""
    import numpy as np

    for s in batches:
        known = s[s.notna()]
        flat = np.concatenate([np.empty(0, "<f4"), *known.to_numpy()]).astype("<f4").tobytes()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) * 4
        ends = np.cumsum(sizes)
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        out[known.index] = pd.Series([flat[a:b] for a, b in zip(ends - sizes, ends, strict=True)], index=known.index, dtype=object)
        yield out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The vector of little-endian 32-bit floats; an error if the length isn't a multiple of four."""
    import numpy as np

    for s in batches:
        yield s.map(lambda v: None if v is None else np.frombuffer(v, "<f4"))


def code_size(dim: int, method: str) -> int:
    """Bytes of a stored vector: four a value, one a value, or none for the method without codes."""
    return {"none": 4 * dim, "scalar_8bit": dim}.get(method, 0)
