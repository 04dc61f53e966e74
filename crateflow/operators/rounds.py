"""Iterative operators: what a round leaves is written to the shared folder, so that lineage is cut and executors may be lost."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df by checkpoint(), in the folder that spark.checkpoint.dir names; a local session without one gets its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and re.fullmatch(r"local(\[[^\]]*\])?", context.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if folder is None:
            import tempfile

            folder = tempfile.mkdtemp(prefix="crateflow-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
