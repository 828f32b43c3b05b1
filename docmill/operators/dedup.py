"""Exact and normalised duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.plans.lineage import cut
from docmill.plans.sizing import small_side


def first_of_each(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row of each key: the first by ``order``. Rows whose key is null all go.

    A struct minimum combines before the shuffle, so a key held by a third of all rows costs one row a task.
    """
    rest = [c for c in df.columns if c not in order]
    packed = F.min(F.struct(*order, *rest))
    return df.filter(key.isNotNull()).groupBy(key.alias("_key")).agg(packed.alias("_row")).select("_row.*").select(*df.columns)


def duplicate_counts(df: DataFrame, key: Column) -> DataFrame:
    """hash, copies of the keys that more than one row has."""
    return df.filter(key.isNotNull()).groupBy(key.alias("hash")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def unseen(df: DataFrame, key: Column, seen: DataFrame, order: list[str]) -> DataFrame:
    """First rows of the keys that aren't among the stored hashes (column ``hash``)."""
    return first_of_each(df.withColumn("_h", key).join(seen.select(F.col("hash").alias("_h")), "_h", "left_anti").drop("_h"), key, order)


def latest(df: DataFrame, id_col: str = "id", order_col: str = "indexed_at") -> DataFrame:
    """One row of each id: that with the greatest ``order_col``, if there is such a column; ties by the other columns.

    A struct maximum combines before the shuffle; rows with a null id stay out.
    """
    rest = [c for c in df.columns if c not in (id_col, order_col)]
    keys = [F.col(order_col)] if order_col in df.columns else []
    packed = F.max(F.struct(*keys, *(F.col(c) for c in rest)))
    return df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(packed.alias("_row")).select(id_col, "_row.*").select(*df.columns)


def current(df: DataFrame, id_col: str = "id", order_col: str = "indexed_at") -> DataFrame:
    """:func:`latest` for a table in which few ids come again: only ids are counted by shuffle, and only the rows of repeated
    ids are gathered; all others stay where they are. Rows with a null id stay out."""
    repeated = cut(df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(id_col))
    n = repeated.count()
    rows = df.filter(F.col(id_col).isNotNull())
    if not n:
        return rows
    keys = small_side(repeated, n)
    return rows.join(keys, id_col, "left_anti").unionByName(latest(rows.join(keys, id_col, "left_semi"), id_col, order_col))
