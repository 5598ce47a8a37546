"""Cutting a lineage in the shared folder that the session names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there; only a local master may do without one that is set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}"))
    return df.checkpoint(eager=True)
