"""The package for Python workers that don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the session's workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_docmill_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="docmill-")) / "docmill.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        sc.addPyFile(str(target))
    sc._docmill_shipped = True
