"""Cutting lineage so that a lost executor costs nothing but its running tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; only where none is set and everything is on one machine, as in tests, a temporary one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or local_folder(spark, "rambleweave-checkpoint-", "set spark.checkpoint.dir to a folder that all executors share"))
    return sc._jsc.sc().getCheckpointDir().get()


def local_folder(spark: SparkSession, prefix: str, otherwise: str) -> str:
    """A temporary folder of this machine; refused on a cluster, whose executors could not reach it."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"a temporary folder of one machine is no use on a cluster: {otherwise}")
    return tempfile.mkdtemp(prefix=prefix)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder and read from there on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
