from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from docmill.functions import vectors as V
from docmill.operators.quantizer import Quantizer, bounds
from docmill.schema import Quantization


def one(spark, column, **values):
    kinds = ", ".join(f"{k} array<float>" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "want"), [([1, 2, 3], [1, 2, 3], 1.0), ([1, 0, 0], [0, 1, 0], 0.0), ([1, 2, 3], [-1, -2, -3], -1.0), ([0, 0, 0], [1, 2, 3], 0.0), ([1, 2], [1, 2, 3], 0.0), (None, [1, 2, 3], None)])
def test_cosine(spark, a, b, want):
    a, b = (None if x is None else [float(v) for v in x] for x in (a, b))
    got = one(spark, V.cosine_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert got == want or got == pytest.approx(want, abs=1e-6)


def test_normalize_distance_score(spark):
    assert one(spark, V.normalize(F.col("a")), a=[3.0, 4.0, 0.0]) == pytest.approx([0.6, 0.8, 0.0])
    assert one(spark, V.normalize(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.squared_l2(F.col("a"), F.col("b")), a=[1.0, 2.0, 9.0], b=[1.0, 4.0]) == 4.0
    assert one(spark, V.distance_to_score(F.lit(3.0), cosine=False), a=[1.0]) == 0.25
    assert one(spark, V.dimension(F.col("a")), a=None) is None


def test_quantizer(spark):
    df = spark.createDataFrame([([0.0, -1.0, 5.0],), ([1.0, 1.0, 5.0],), ([0.5, 0.0, 5.0],), (None,)], "vector array<float>")
    q = Quantizer().fit(df)
    assert q.dimension == 3 and q.high[2] - q.low[2] == pytest.approx(1e-5)
    probe = spark.createDataFrame([([0.3, 0.2, 5.0],), ([-9.0, 9.0, 5.0],), (None,)], "vector array<float>")
    got = probe.select(q.encode(F.col("vector")).alias("c"), q.decode(q.encode(F.col("vector"))).alias("v")).collect()
    assert all(abs(a - b) < 0.1 for a, b in zip(got[0].v, [0.3, 0.2, 5.0]))
    assert got[1].c[:2] == [0, 255] and got[2].c is None
    assert Quantizer.from_json(q.to_json()) == q and q.code_size() == 3
    with pytest.raises(ValueError):
        Quantizer.from_json('{"method": "scalar_8bit", "dimension": 4, "min_values": [0], "max_values": [1]}')
    with pytest.raises(ValueError):
        Quantizer().fit(df.limit(0))
    with pytest.raises(ValueError):
        Quantizer().fit(df.union(spark.createDataFrame([([1.0],)], "vector array<float>")))
    with pytest.raises(NotImplementedError):
        Quantizer(Quantization.PRODUCT).fit(df)
    assert bounds(df.limit(0)).count() == 0


def test_raw_codec(spark):
    df = spark.createDataFrame([([1.5, -2.25, math.pi],), (None,)], "v array<float>")
    a, b = df.select(V.to_bytes(F.col("v")).alias("b"), V.from_bytes(V.to_bytes(F.col("v"))).alias("w"), "v").collect()
    assert len(a.b) == 12 and a.w == a.v and b.b is None and b.w is None


def test_checks_raise(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    with pytest.raises(Exception, match="expected 3 values"):
        df.select(V.check_dimension(F.col("v"), 3)).collect()
