"""Listing, deleting and expiring documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import source_of


def list_sources(df: DataFrame, url_col: str = "url") -> DataFrame:
    """source, documents: number of documents of each url (``local`` without one)."""
    return df.groupBy(source_of(F.col(url_col)).alias("source")).agg(F.count(F.lit(1)).alias("documents"))


def documents_by_source(df: DataFrame, id_col: str = "id", url_col: str = "url") -> DataFrame:
    """source and position of each document in it, by id: one row a document, so that a source with a
    large part of all documents is never gathered in one row."""
    return df.select(source_of(F.col(url_col)).alias("source"), F.col(id_col).alias("id"))


def is_source(source: str, url_col: str = "url") -> Column:
    """Rows of a source: exactly that url; ``local`` means those without one."""
    return source_of(F.col(url_col)) == source


def delete_source(df: DataFrame, source: str, url_col: str = "url") -> DataFrame:
    """The documents that stay."""
    return df.filter(~is_source(source, url_col))


def delete_id(df: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """The documents that stay; those without an id do."""
    return df.filter(F.coalesce(F.col(id_col) != value, F.lit(True)))


def is_fresh(now: datetime, max_age_days: int, updated_col: str = "last_updated", indexed_col: str = "indexed_at") -> Column:
    """Updated (or else indexed) later than ``max_age_days`` before ``now``; the cutoff is never before 1970."""
    seconds = max(0.0, now.timestamp() - max_age_days * 86400)
    return F.coalesce(F.coalesce(F.col(updated_col), F.col(indexed_col)).cast("timestamp").cast("double") > seconds, F.lit(False))


def expire(df: DataFrame, now: datetime, max_age_days: int = 90, updated_col: str = "last_updated", indexed_col: str = "indexed_at") -> DataFrame:
    """The documents that stay. One with neither time counts as expired."""
    return df.filter(is_fresh(now, max_age_days, updated_col, indexed_col))


def dry_run(df: DataFrame, gone: Column) -> DataFrame:
    """One row: how many documents would go and stay."""
    return df.agg(F.count_if(gone).alias("would_remove"), F.count_if(~gone).alias("would_remain"))
