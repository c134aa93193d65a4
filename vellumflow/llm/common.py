"""Shared helpers: inputs, hash folds, durable staging and size-derived partition counts."""

from __future__ import annotations

import os
import sys
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession, batch_rows: int = 1000) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches of whole texts small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if root not in sys.path:
        sys.path.append(root)
    # The setting is read when a plan runs, which may be after later calls: none may make batches of whole texts large.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(batch_rows, 1000)))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids fold as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts that are pure ASCII take the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees; a local default only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellumflow-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a staged folder when the driver's JVM ends; results may be read until then."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, nor any that differs from one in case only or goes on from it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(stem.lower()) for c in taken):
        stem = f"_{stem}"
    return stem


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def source_file(name: str) -> str:
    """A tokenizer file: a path as given, or a bare file name looked up among the public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later steps read as they are.

    Filters and projections are not pushed through a generator, so an expression
    that is costly, or that lambdas refer to for every element, is computed once
    for each row and never copied into its readers.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
