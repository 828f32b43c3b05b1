"""Fusion of vector and keyword ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.bm25 import Bm25Index, build_index, keyword_topk
from docmill.operators.search import exact_topk, filtered
from docmill.schema import HybridOptions


def squash(score: Column) -> Column:
    """A keyword score brought into 0 to 1."""
    return F.least(score / (1 + score), F.lit(1.0))


def hybrid_topk(df: DataFrame, query: Sequence[float], text: str, options: HybridOptions | None = None, index: Bm25Index | None = None, id_col: str = "id", vector_col: str = "vector", text_col: str = "content", url_col: str = "url", type_col: str = "content_type") -> DataFrame:
    """(id, vector_score, keyword_score, combined_score) of the best ``limit`` documents.

    Three times the limit comes from each side: the vectors under the filters, the keywords over the
    statistics of all documents with the filters afterwards; a document that one side
    lacks has 0 there. The minimum score holds for vector hits and for the combined score of documents
    that only keywords found. With ``enabled=False`` the vectors alone decide.
    """
    options = options or HybridOptions()
    base, k = options.base, max(0, options.base.limit)
    if not options.enabled:
        only = exact_topk(df, query, base, id_col, vector_col, url_col, type_col)
        return only.select(F.col(id_col).alias("id"), F.col("score").alias("vector_score"), F.lit(0.0).alias("keyword_score"), F.col("score").alias("combined_score"))
    index = index or build_index(df, id_col, text_col)
    near = exact_topk(df, query, replace(base, limit=3 * k), id_col, vector_col, url_col, type_col).select(F.col(id_col).alias("id"), F.col("score").alias("v"))
    words = keyword_topk(index, text, 3 * k, options.bm25).select("id", squash(F.col("score")).alias("w"))
    # both sides have at most 3 k rows
    allowed = filtered(df, base, url_col, type_col).select(F.col(id_col).alias("id"))
    words = allowed.join(F.broadcast(words), "id").distinct()
    both = near.join(words, "id", "full_outer")
    v, w = F.coalesce("v", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
    fused = both.select("id", v.alias("vector_score"), w.alias("keyword_score"), (options.vector_weight * v + options.keyword_weight * w).alias("combined_score"), F.col("v").isNotNull().alias("near"))
    if base.min_score is not None:
        fused = fused.filter(F.col("near") | (F.col("combined_score") >= base.min_score))
    fused = fused.drop("near")
    best = [F.col("combined_score").desc(), F.col("id")]
    if not options.compat_heap:
        return fused.orderBy(*best).limit(k)
    # of C > 2 k candidates the ranks from C - 2 k + 1 on; the set is at most 6 k rows
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    first = F.greatest(n - 2 * k, F.lit(0))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*best))).withColumn("first", first)
    return ranked.filter((F.col("rank") > F.col("first")) & (F.col("rank") <= F.col("first") + k)).drop("rank", "first")
