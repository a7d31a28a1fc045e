"""Cutting lineage with tables in a folder that all executors share.

An intermediate result that is read more than once, or that a loop builds on, is written as a
Parquet table below `spark.checkpoint.dir` and read back: it survives the loss of any executor and
its size on disk is known to the planner, which then picks broadcast or shuffle joins by it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the one named by spark.checkpoint.dir, removed when the driver ends; a
    temporary one of this process only in local mode where that setting is absent."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        app = spark.sparkContext.applicationId
        if app not in _own:
            path, fs = _path(spark, f"{named.rstrip('/')}/versemill-{app}")
            fs.mkdirs(path)
            fs.deleteOnExit(path)
            _own[app] = path.toString()
        return _own[app]
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="versemill-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def _path(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df`, written to a table in the shared folder and read back."""
    spark = df.sparkSession
    location = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(location)
    out = spark.read.schema(df.schema).parquet(location)
    out._cut_at = location
    return out


def sweep(spark: SparkSession) -> None:
    """Removes all tables that this application has cut so far; results that were not yet read are lost."""
    path, fs = _path(spark, shared_dir(spark))
    for entry in fs.listStatus(path):
        fs.delete(entry.getPath(), True)


def drop(df: DataFrame) -> None:
    """Removes the table behind a result of cut() that nothing reads any more."""
    location = getattr(df, "_cut_at", None)
    if location:
        path, fs = _path(df.sparkSession, location)
        fs.delete(path, True)
