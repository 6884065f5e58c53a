"""Tables that an operator writes for itself: below the folder that driver and executors share, until the driver ends."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_removed: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local runs have one of their own; a cluster must name it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="strandlake-")
    return _own[sc.applicationId]


def fs_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. What this application has written there is removed when its driver ends."""
    root = f"{shared_dir(spark)}/strandlake/{spark.sparkContext.applicationId}"
    if root not in _removed:
        fs, path = fs_path(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _removed.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    A lost executor costs the tasks it was running and nothing that was written before.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing will read again, such as the last round's of a loop."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, path = fs_path(df.sparkSession, folder)
        fs.delete(path, True)
