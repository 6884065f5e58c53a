"""The policy register: a CSV file with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.schemas import POLICY


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the register. A row with too many fields keeps the first ones, and the whole of it in _corrupt_record."""
    reader = spark.read.schema(POLICY).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", True).option("escape", '"').csv(path)
