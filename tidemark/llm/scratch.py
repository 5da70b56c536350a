"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; below the temp folder where that is unset and the session is a local one. On a cluster it has to be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str = "table", free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs at most one step, and gives
    both sides of a later join plain scans, so AQE can split hot keys.
    ``free``: the shuffle files of finished steps are let go at once, not when
    the driver next happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.options(compression="zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def tables() -> int:
    """How many tables have been written so far: a mark for :func:`discard`."""
    return len(_written)


def discard(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables written after a mark, but for those of these names; call it when nothing reads them again."""
    jvm = spark.sparkContext._jvm
    for folder in _written[since:]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not any(files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")) for name in keep):
            files.delete(path, True)
            _written.remove(folder)


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`written` made; call it once the results are stored."""
    discard(spark, 0)
