"""Cutting lineage on storage that every executor can reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder of reliable checkpoints.

    ``spark.checkpoint.dir`` of the session wins; only a session without it (tests, notebooks on
    one machine) gets a folder of its own.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="scriptorium-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def reliable(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a replicated checkpoint (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
