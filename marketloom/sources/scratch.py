"""Tables that a plan writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or in a temporary folder where that is unset, as in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or f"file://{tempfile.gettempdir()}").rstrip("/") + f"/marketloom-{name}-{uuid.uuid4().hex}"


#: Folders that `materialise` wrote, by application.
_WRITTEN: dict[str, list[str]] = {}


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, written as Parquet and read again: what follows doesn't compute them anew, and lost executors don't matter. They stay until `clear`."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes what `materialise` wrote in this application, and returns how many tables that were; frames that read them can't be used any more."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for folder in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
