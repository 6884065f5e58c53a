"""Shared helpers of the training-data operators: the shared scratch folder, written cut-points, table access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_removed: set[str] = set()
_keeper: list[tuple[str, Callable[[], None]]] = []


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


def _path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. What this application has written there is removed when its driver ends."""
    root = f"{shared_dir(spark)}/strandlake/{spark.sparkContext.applicationId}"
    if root not in _removed:
        fs, path = _path(spark, root)
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
        fs, path = _path(df.sparkSession, folder)
        fs.delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_that_pass(docs: DataFrame, column: str, make: Callable[[], Callable[[pa.Array], list[bool]]]) -> DataFrame:
    """The rows, whatever the names of their columns, for which a test of one column holds; make gives a task its test of a batch."""
    at = docs.columns.index(column)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for b in in_turn(batches):
            yield b.filter(pa.array(test(b.column(0).field(at)), pa.bool_()))

    return packed.mapInArrow(run, packed.schema).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def give_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches one after another; what was freed with one goes back before the next, as a worker would else keep several times its needs."""
    for b in batches:
        yield b
        give_back()


def keep_in_worker(name: str, release: Callable[[], None]) -> None:
    """Called by a task before it keeps anything for later tasks of its process: what another operator has kept there goes first.

    Workers serve one stage after another, so that what all of them keep would add up; freed memory is given back.
    """
    if _keeper and _keeper[0][0] != name:
        _keeper.pop()[1]()
        gc.collect()
    give_back()
    if not _keeper:
        _keeper.append((name, release))
