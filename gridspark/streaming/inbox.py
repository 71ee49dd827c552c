"""Workbooks that arrive in a folder, decomposed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridspark.plans.pipeline import decompose
from gridspark.sinks.store import write_tables
from gridspark.sources.tables import temporary_tables


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.xls[xm]", once: bool = False, files_per_batch: int = 1000) -> StreamingQuery:
    """Every micro-batch of at most `files_per_batch` new files becomes one run in the tables under `out`; a batch that is retried after a failure
    overwrites its own run."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")

    def put(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select(F.regexp_replace("path", "^file:/*", "/").alias("path")).collect()]
        if paths:
            with temporary_tables(batch.sparkSession):
                write_tables(decompose(batch.sparkSession, paths), out, f"batch-{number:09d}")

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
