"""Cutting the lineage of loops in shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the folder the cluster names; in a temporary one of our own only where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint()
