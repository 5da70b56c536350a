"""Tables stored between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; below the temp folder where that is unset and the session is a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    _made.append(f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}")
    return _made[-1]


def stored(table: DataFrame, path: str | None = None, by: str | None = None) -> DataFrame:
    """``table``, written (to a new shared folder, or ``path``; a folder a value of ``by``) and read again: steps that read it many times, or only part of it, don't compute it anew."""
    spark = table.sparkSession
    path = path or shared_folder(spark)
    table.write.parquet(path, partitionBy=by)
    return spark.read.schema(table.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _made:
        _made.remove(path)


def release(spark: SparkSession) -> int:
    """Delete all that was stored so far, and tell how many folders that was; for when the results that were made from them are written."""
    gone = list(_made)
    for path in gone:
        removed(spark, path)
    return len(gone)
