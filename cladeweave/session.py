"""A session with the settings that the engine expects, and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "cladeweave", cores: int = 0, log_level: str | None = None) -> SparkSession:
    """The active session, or a local one; on a cluster spark-submit sets master and memory."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if not os.environ.get("SPARK_MASTER") and "PYSPARK_SUBMIT_ARGS" not in os.environ:
        builder = builder.master(f"local[{cores or '*'}]").config("spark.sql.shuffle.partitions", str(cores or os.cpu_count() or 8))
    spark = builder.getOrCreate()
    if log_level:
        spark.sparkContext.setLogLevel(log_level)
    return spark


def checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: the one in spark.checkpoint.dir, else a temporary one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cladeweave_")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df written to the shared folder, in a folder for each value of keys, and read back: its lineage ends in files that outlive executors."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*keys).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
