"""Extension: a folder of packages as a stream; each micro-batch is converted as a whole.

A package is the unit: its fields, lists and tables span paragraphs, so it is
never split across batches.  The checkpoint remembers which files are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellumflow.plans.convert import Options, convert_files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", files_per_batch).load(folder)


def convert_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Convert what is there now and append documents to ``out`` as Parquet, one folder for each batch (rewritten if a batch is retried)."""

    def one(batch: DataFrame, number: int) -> None:
        convert_files(batch.select("path", "content"), options).documents.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
