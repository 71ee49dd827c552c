"""Tables as they are scanned, and tables written for the length of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def spread(scan: DataFrame, task_rows: int | None = None) -> DataFrame:
    """A scan whose rows are dealt to all cores. A small file is one partition, however much work its rows are; it is
    dealt anew (that is, shuffled) only then. A scan with as many partitions as there are cores stays what it is. With
    task_rows, for rows that become many, there are so many partitions that none has many more rows than that."""
    least = scan.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        least = max(least, -(-scan.count() // task_rows))  # without columns: the file's footers say
    return scan.repartition(least) if scan.rdd.getNumPartitions() < least else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only where none is set and driver and tasks
    are one process (tests, one machine) is one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gridspark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The open `temporary_tables` of this thread or task, outermost first, with the tables written in each.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open temporary tables", default=())


def written(df: DataFrame, block_bytes: int | None = None, file_rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder. Unlike a checkpoint it is read as a plain scan, so that the planner knows its
    size and is free to deal it out anew (a skewed join needs that). A file is read by as many tasks as it has row groups;
    block_bytes makes these smaller than usual, for rows that are much work each. Where such rows take so few bytes that
    Spark wouldn't split a file, file_rows bounds the rows of each, so that no task is dealt a hot one."""
    path = f"{shared_folder(df.sparkSession)}/gridspark-{uuid.uuid4().hex}"
    if jobs := _OPEN.get():
        jobs[-1].append(path)
    writer = df.write if block_bytes is None else df.write.option("parquet.block.size", block_bytes)
    (writer if file_rows is None else writer.option("maxRecordsPerFile", file_rows)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """What `written` writes inside is deleted at the end, so results must be written or collected before. Each table
    belongs to the innermost job that is open where it is written: other threads' jobs, and jobs that began earlier and
    end sooner, leave it alone."""
    paths: list[str] = []
    _OPEN.set((*_OPEN.get(), paths))
    try:
        yield
    finally:
        _OPEN.set(tuple(p for p in _OPEN.get() if p is not paths))
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """The folder is removed from whatever file system holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
