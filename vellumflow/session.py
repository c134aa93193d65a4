"""Session helpers shared by the document operators."""

from __future__ import annotations

import os
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session import the package (for the ZIP and XML table functions)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if root not in sys.path:
        sys.path.append(root)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees (``spark.checkpoint.dir``); a local default only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: later steps neither recompute nor replan what came before.

    The folder goes when the driver's JVM ends.
    """
    path = f"{shared_dir(df.sparkSession)}/vellumflow-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)
