"""Access to the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (one file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan for an operator that computes much on each row: where it has fewer splits than the
    cluster has cores, its rows (few bytes then) are dealt out; a larger scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with equal columns together, in parts that stay as many as the session's for a shuffle, or the cores if these are more: few
    bytes that are much work to each row aren't gathered in a few tasks. What groups or windows by these columns needs no further shuffle."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *columns)
