"""The index on disk: vectors, metadata and postings in versions, and a manifest that says which one holds.

A build writes a version of its own and then a manifest row; readers follow the newest row, so that a failed build leaves the
last one in place. Vectors are keyed by embedder, so that two of them don't displace each other. Metadata lies apart from
vectors and can be renewed without embedding again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import chunking, dense, lexical
from strandlake.schemas import MANIFEST, METADATA


@dataclass
class Index:
    spark: SparkSession
    path: str
    embedder: dense.Embedder

    @property
    def root(self) -> str:
        return f"{self.path.rstrip('/')}/{self.embedder.name.replace(':', '_').replace('/', '_')}"

    def info(self) -> dict | None:
        """The manifest's newest row, or None where nothing is built."""
        if not lexical._exists(self.spark, f"{self.root}/manifest"):
            return None
        row = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").orderBy(F.desc("built_at"), F.desc("version")).first()
        return row.asDict() if row else None

    def is_fresh(self, fingerprint: str, n_chunks: int) -> bool:
        found = self.info()
        return found is not None and (found["fingerprint"], found["embedder"], found["n_chunks"]) == (fingerprint, self.embedder.name, n_chunks)

    def _commit(self, fingerprint: str, meta_fingerprint: str, n_chunks: int, version: str) -> None:
        now = dt.datetime.now(dt.UTC).isoformat(timespec="microseconds")
        row = (fingerprint, meta_fingerprint, self.embedder.name, now, n_chunks, version)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def build(self, chunks: DataFrame, fingerprint: str, meta_fingerprint: str) -> None:
        version = uuid.uuid4().hex[:12]
        at = f"{self.root}/{version}"
        embedded = chunks.select("ordinal", "chunk_id", "kind", "source", self.embedder.documents(F.col("text")).alias("v"))
        # the rebalance bounds files; a filter on kind or source reads its own folders only
        embedded.hint("rebalance", "kind", "source").write.mode("overwrite").partitionBy("kind", "source").parquet(f"{at}/vectors")
        lexical.save(lexical.build(chunks, "chunk_id", "text", "ordinal", ("kind", "source")), f"{at}/lexical")
        chunks.write.mode("overwrite").parquet(f"{at}/chunks-{meta_fingerprint}")
        self._commit(fingerprint, meta_fingerprint, chunks.count(), version)

    def sync_metadata(self, chunks: DataFrame, meta_fingerprint: str) -> bool:
        """Renew what can be filtered by, if it changed, without embedding; tells whether it did."""
        found = self.info()
        if found is None or found["meta_fingerprint"] == meta_fingerprint:
            return False
        chunks.write.mode("overwrite").parquet(f"{self.root}/{found['version']}/chunks-{meta_fingerprint}")
        self._commit(found["fingerprint"], meta_fingerprint, found["n_chunks"], found["version"])
        return True

    def refresh(self, chunks: DataFrame, rebuild: bool = False) -> str:
        """built, synced or reused. Chunks are made once, into a table that is removed afterwards, and hashed, counted and embedded from it."""
        at = f"{self.root}/incoming-{uuid.uuid4().hex[:12]}"
        try:
            chunks.write.parquet(at)
            chunks = self.spark.read.schema(chunks.schema).parquet(at)
            both = chunking.fingerprint_tree(chunks).join(chunking.metadata_fingerprint_tree(chunks), F.lit(True)).first()  # a row each
            n = chunks.count()
            if rebuild or not self.is_fresh(both["fingerprint"], n):
                self.build(chunks, both["fingerprint"], both["meta_fingerprint"])
                return "built"
            return "synced" if self.sync_metadata(chunks, both["meta_fingerprint"]) else "reused"
        finally:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _now(self) -> tuple[dict, str]:
        found = self.info()
        if found is None:
            raise RuntimeError(f"no index at {self.root}; build it first")
        return found, f"{self.root}/{found['version']}"

    def chunks(self) -> DataFrame:
        found, at = self._now()
        return self.spark.read.parquet(f"{at}/chunks-{found['meta_fingerprint']}")

    def vectors(self) -> DataFrame:
        """id, ordinal, v with the chunks' present metadata."""
        _, at = self._now()
        kept = self.spark.read.parquet(f"{at}/vectors").select(F.col("chunk_id").alias("id"), "v")
        return kept.join(self.chunks().select(F.col("chunk_id").alias("id"), "ordinal", *METADATA), "id")

    def lexical(self) -> lexical.LexicalIndex:
        _, at = self._now()
        return lexical.load(self.spark, f"{at}/lexical")
