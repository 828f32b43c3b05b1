"""Lineage cuts that survive the loss of an executor.

A cut is always a reliable ``checkpoint()`` in the folder that the session
names in ``spark.checkpoint.dir``; only where that setting is absent (local
sessions, tests) a folder of our own is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set to a fresh one only for a local session without any."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="docmill-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it to the checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder for tables, beside the checkpoints in the shared folder."""
    return f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
