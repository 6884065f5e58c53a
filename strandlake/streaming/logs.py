"""Streams: the retrieval log as it is appended, and documents as they arrive.

Nothing here needs time windows: a log is append-only, and a document's chunks replace those that it had. Batches are written
under their number, so that a batch that is run again after a failure overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators.chunking import chunk_texts
from strandlake.operators.runlog import EVIDENCE_TOOL
from strandlake.schemas import LOG


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).parquet(path)


def retrieved_stream(log: DataFrame) -> DataFrame:
    """run_id, chunk_id that runs have read, each once; its state grows with the different pairs."""
    return log.where(F.col("tool") != EVIDENCE_TOOL).select("run_id", F.explode("chunk_ids").alias("chunk_id")).dropDuplicates(["run_id", "chunk_id"])


def chunk_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Chunk markdown files as they come in. Each batch is one folder of Parquet; newest_chunks reads them."""

    def write(batch: DataFrame, n: int) -> None:
        # several files of a source in one batch: the newest
        texts = batch.groupBy("source").agg(F.max_by("value", "at").alias("value"))
        chunk_texts(texts).write.mode("overwrite").parquet(f"{path}/batch={n}")
        if then:
            then(batch, n)

    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    named = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1).alias("source"), "value", F.col("_metadata.file_modification_time").alias("at"))
    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Of each source the chunks of the last batch that it came in."""
    every = spark.read.parquet(path)
    last = every.groupBy("source").agg(F.max("batch").alias("batch"))
    return every.join(last, ["source", "batch"])
