"""Cutting lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session. One of our own only where none is named and one machine runs all tasks."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="specweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def tasks_for(df: DataFrame, each: int = 8 << 20) -> int:
    """Tasks of at most ``each`` stored bytes of df, at least one a core: a fixed number would have a task grow with its input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, min(8192, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // each)))


def cut(df: DataFrame) -> DataFrame:
    """df as written to the checkpoint folder: worked out once, read by every later plan, kept when executors go."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder: written in one pass, and of a size that later joins know."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
