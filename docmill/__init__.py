"""Spark-first engine for building and querying documentation knowledge bases."""

__version__ = "0.1.0"
