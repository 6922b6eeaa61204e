"""Cutting lineage where a plan is read several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder; only where none is set and all runs on this machine, as in tests, in a temporary one."""
    root(df.sparkSession)
    return df.checkpoint()


def root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="palaver-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one."""
    return f"{root(spark).rstrip('/')}/palaver-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder as Parquet; joins in it leave rows where they are dealt by some of the keys on both sides already."""
    spark, rule = df.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition"
    path, before = folder(spark), spark.conf.get(rule)
    spark.conf.set(rule, "false")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(rule, before)
    return spark.read.schema(df.schema).parquet(path)
