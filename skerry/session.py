"""Settings of the session that operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only on a local master without it, a temporary folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="skerry-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Name the shared folder for checkpoints, where the session has none yet."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
