"""Settings from the session's configuration, then the environment, then defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.strandlake."


@dataclass(frozen=True)
class Settings:
    regulations_dir: str = "data/regulations"
    policies_csv: str = "data/policies/policy_register.csv"
    index_dir: str = "data/index"
    cache_dir: str = "data/cache"
    output_dir: str = "out"
    retrieval_mode: str = "auto"
    embed_dim: int = 1024

    @classmethod
    def load(cls, spark: SparkSession) -> Settings:
        found = {}
        for f in fields(cls):
            value = spark.conf.get(PREFIX + f.name, os.environ.get(f"STRANDLAKE_{f.name.upper()}"))
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)
