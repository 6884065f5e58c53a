"""Labelled questions for retrieval: a JSON object with an array of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.schemas import GOLD


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """query_id, source, q, articles, type; a case without a type is a paraphrase."""
    cases = spark.read.schema(f"cases array<{GOLD.simpleString()}>").option("multiLine", True).json(path)
    flat = cases.select(F.posexplode("cases").alias("query_id", "c"))
    return flat.select(F.col("query_id").cast("long"), "c.source", "c.q", "c.articles", F.coalesce("c.type", F.lit("paraphrase")).alias("type"))
