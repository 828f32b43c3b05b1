"""The functions by name, for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docmill.functions.html import extract
from docmill.operators import chunking
from docmill.schema import EXTRACTED, ChunkStrategy, FixedSize, HeadingBased, Semantic

_PIECES = "array<struct<start_char:bigint,end_char:bigint,content:string,heading:string,heading_context:string>>"

#: SQL functions whose body is an expression, so the optimizer sees through them.
EXPRESSIONS = {
    "doc_tokenize(t STRING) RETURNS ARRAY<STRING>": r"filter(transform(split(lower(t), r'[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), x -> regexp_replace(x, r'^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$', '')), x -> x <> '')",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) <> size(b) OR vector_dot(a, a) = 0 OR vector_dot(b, b) = 0 THEN 0D ELSE vector_dot(a, b) / sqrt(vector_dot(a, a) * vector_dot(b, b)) END",
    "vector_quantize(v ARRAY<DOUBLE>, low ARRAY<DOUBLE>, high ARRAY<DOUBLE>) RETURNS ARRAY<INT>": "transform(arrays_zip(v, low, high), s -> CASE WHEN s.high - s.low <= 0 THEN 0 ELSE least(255, greatest(0, CAST(round((s.v - s.low) / (s.high - s.low) * 255) AS INT))) END)",
    "estimate_tokens(t STRING) RETURNS BIGINT": "octet_length(t) DIV 4",
}


def _chunker(strategy: Callable[[int, int], ChunkStrategy]):
    """Chunks of a text by a strategy of two sizes, as a function of a batch."""

    @F.pandas_udf(_PIECES)
    def cut(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        fields = ("start_char", "end_char", "content", "heading", "heading_context")
        return pd.Series([None if t is None else [dict(zip(fields, p, strict=True)) for p in chunking.pieces(t, strategy(int(a), int(b)))] for t, a, b in zip(text, first, second, strict=True)])

    return cut


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    names = []
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    for name, of in (("chunk_fixed", lambda a, b: FixedSize(a, b)), ("chunk_paragraphs", lambda a, b: Semantic(a, b)), ("chunk_headings", lambda a, b: HeadingBased(a, b))):

        spark.udf.register(name, _chunker(of))
        names.append(name)

    @F.pandas_udf(EXTRACTED)
    def page(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [extract(h, u) or dict.fromkeys(EXTRACTED.fieldNames()) for h, u in zip(html, url, strict=True)]
        return pd.DataFrame({n: [r[n] for r in rows] for n in EXTRACTED.fieldNames()})

    spark.udf.register("extract_html", page)
    return [*names, "extract_html"]
