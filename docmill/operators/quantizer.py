"""8-bit scalar quantisation of vectors."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import vectors
from docmill.schema import Quantization

#: Least range of a dimension, and what a narrower one is widened by.
LEAST_RANGE, WIDENED = 1e-6, 1e-5


def bounds(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """dim (from 0), low, high of each dimension; a range below 1e-6 is widened. Null vectors take no part."""
    each = df.filter(F.col(vector_col).isNotNull()).select(F.posexplode(vector_col).alias("dim", "x"))
    found = each.groupBy("dim").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    return found.select("dim", "low", F.when(F.col("high") - F.col("low") < LEAST_RANGE, F.col("high") + WIDENED).otherwise(F.col("high")).alias("high"))


@dataclass
class Quantizer:
    """Bounds of each dimension; ``low`` and ``high`` are empty until fitted."""

    method: Quantization = Quantization.SCALAR_8BIT
    dimension: int = 0
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()

    def fit(self, df: DataFrame, vector_col: str = "vector") -> Quantizer:
        """Bounds of all vectors. An error for no vectors, vectors of other dimensions, or product quantisation."""
        if self.method is Quantization.NONE:
            return self
        if self.method is Quantization.PRODUCT:
            raise NotImplementedError("product quantisation has no codec")
        sizes = [r.n for r in df.filter(F.col(vector_col).isNotNull()).select(F.size(vector_col).alias("n")).distinct().limit(2).collect()]
        if not sizes:
            raise ValueError("no vectors to fit on")
        if len(sizes) > 1 or (self.dimension and sizes[0] != self.dimension):
            raise ValueError(f"vectors of {sizes} values, expected {self.dimension or 'one dimension'}")
        rows = sorted(bounds(df, vector_col).collect())  # one row a dimension
        return Quantizer(self.method, sizes[0], tuple(r.low for r in rows), tuple(r.high for r in rows))

    def _bounds(self) -> tuple[Column, Column]:
        if self.method is Quantization.PRODUCT:
            raise NotImplementedError("product quantisation has no codec")
        if len(self.low) != self.dimension or not self.dimension:
            raise ValueError("the quantizer is not fitted")
        return vectors.literal(self.low), vectors.literal(self.high)

    def encode(self, v: Column) -> Column:
        """Codes (array<int>), or little-endian bytes without a method."""
        return vectors.to_bytes(v) if self.method is Quantization.NONE else vectors.quantize(v, *self._bounds())

    def decode(self, codes: Column) -> Column:
        return vectors.from_bytes(codes) if self.method is Quantization.NONE else vectors.dequantize(codes, *self._bounds())

    def code_size(self) -> int:
        return vectors.code_size(self.dimension, self.method.value)

    def to_json(self) -> str:
        return json.dumps({"method": self.method.value, "dimension": self.dimension, "min_values": self.low, "max_values": self.high})

    @classmethod
    def from_json(cls, text: str) -> Quantizer:
        """An error for an unknown method or bounds that don't fit the dimension."""
        d = json.loads(text)
        out = cls(Quantization(d["method"]), int(d["dimension"]), tuple(d.get("min_values", ())), tuple(d.get("max_values", ())))
        if out.method is Quantization.SCALAR_8BIT and not len(out.low) == len(out.high) == out.dimension:
            raise ValueError("bounds and dimension differ")
        return out
