"""The retrieval log: an append-only table of what each run read, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.schemas import LOG

EVIDENCE_TOOL = "review_evidence"


def entries(hits: DataFrame, queries: DataFrame, tool: str, run_id: str) -> DataFrame:
    """A log row for each query, with the ids that it found in order of rank; none is an empty list."""
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    none = F.array().cast("array<string>")
    return queries.join(found, "query_id", "left").select(F.lit(run_id).alias("run_id"), F.col("query_id").alias("seq"), F.lit(tool).alias("tool"), F.col("q").alias("query"), F.coalesce("ids", none).alias("chunk_ids"))


def append(log: DataFrame, more: DataFrame) -> DataFrame:
    """Both logs as they are: a bag union, in which repeated rows stay."""
    return log.unionByName(more)


def write(more: DataFrame, path: str) -> None:
    more.select(*(F.col(f.name).cast(f.dataType) for f in LOG)).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def retrieved(log: DataFrame) -> DataFrame:
    """run_id, chunk_id that a run searched for and read. Evidence for a review is fetched by citation and doesn't count."""
    return log.where(F.col("tool") != EVIDENCE_TOOL).select("run_id", F.explode("chunk_ids").alias("chunk_id")).distinct()


def last_by(messages: DataFrame, speaker: str, key: str = "run_id") -> DataFrame:
    """key, text: the last message of a speaker in each conversation."""
    return messages.where(F.col("source") == speaker).groupBy(key).agg(F.max_by("text", "pos").alias("text"))


def numbered(log: DataFrame) -> DataFrame:
    return log.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")))
