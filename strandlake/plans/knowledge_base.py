"""The engine's front: one object over chunks, index and retriever."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import chunking, dense, evaluate, fusion, grounding, index, runlog
from strandlake.sources.markdown import read_markdown
from strandlake.sources.policies import read_policies


class KnowledgeBase:
    def __init__(self, spark: SparkSession, built: index.Index, mode: str = "auto") -> None:
        self.spark, self.index = spark, built
        self.mode = fusion.resolve_mode(mode, built.embedder.name)
        self.chunks = built.chunks()
        self.retriever = fusion.Retriever(built.lexical(), built.vectors(), built.embedder)

    @classmethod
    def load(cls, spark: SparkSession, regulations_dir: str, policies_csv: str, index_dir: str, embedder: dense.Embedder | None = None, rebuild: bool = False, mode: str = "auto") -> KnowledgeBase:
        """Read the corpus, and build, renew or reuse its index. Files are read anew on each call, so edits are noticed."""
        regulations = chunking.chunk_texts(read_markdown(spark, regulations_dir))
        chunks = chunking.corpus(regulations, chunking.chunk_policies(read_policies(spark, policies_csv)))
        built = index.Index(spark, index_dir, embedder or dense.default_embedder())
        built.refresh(chunks, rebuild)
        return cls(spark, built, mode)

    def _queries(self, queries: DataFrame | str | list[str]) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries
        asked = [queries] if isinstance(queries, str) else queries
        return self.spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")

    def search(self, queries: DataFrame | str | list[str], k: int = 5, kind: str | None = None, source: str | None = None, mode: str | None = None) -> DataFrame:
        """Hits with their chunks, a batch of queries at once."""
        hits = self.retriever.search(self._queries(queries), k, mode or self.mode, fusion.filters(kind, source))
        return fusion.hydrate(hits, self.chunks)

    def search_regulation(self, queries, source: str, k: int = 5) -> DataFrame:
        return self.search(queries, k, "regulation", source)

    def search_policies(self, queries, k: int = 4) -> DataFrame:
        return self.search(queries, k, "policy")

    def logged_search(self, queries, run_id: str, tool: str, k: int = 5, kind: str | None = None, source: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The text for a reader of each query, and the rows for the log."""
        asked = self._queries(queries)
        hits = self.retriever.search(asked, k, self.mode, fusion.filters(kind, source))
        found = fusion.hydrate(hits, self.chunks)
        return fusion.formatted(asked, found), runlog.entries(hits, asked, tool, run_id)

    def get(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id") == chunk_id)

    def provision(self, chunk_ids: list[str], run_id: str) -> tuple[DataFrame, DataFrame]:
        """Texts of asked ids, and the rows for the log."""
        asked = self.spark.createDataFrame(list(enumerate(chunk_ids)), "query_id long, cid string")
        found = grounding.provision(asked, self.chunks)
        log = found.select(F.lit(run_id).alias("run_id"), F.col("query_id").alias("seq"), F.lit("get_provision").alias("tool"), F.col("cid").alias("query"), "chunk_ids")
        text = F.coalesce("text", F.concat(F.lit("No provision "), "cid", F.lit(".")))
        return found.select("query_id", text.alias("text")), log

    def resolve(self, cites: DataFrame) -> DataFrame:
        return grounding.resolve(cites, self.chunks)

    def outline(self, source: str) -> DataFrame:
        return chunking.outline(self.chunks.where(F.col("source") == source))

    def sources(self) -> DataFrame:
        return chunking.regulation_sources(self.chunks)

    def verify(self, texts: DataFrame, retrieved: DataFrame, key: str = "run_id") -> DataFrame:
        return grounding.verify(grounding.extract(texts, key), self.chunks, retrieved, key)

    def evaluate(self, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Measures and misses of labelled questions."""
        ranks = evaluate.run(self.retriever, cases, self.chunks)
        return evaluate.metrics(ranks), evaluate.misses(ranks)
