"""Hybrid retrieval: rankings fused by reciprocal rank."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import dense, lexical
from strandlake.staging import materialize

# The constant of the fusion, and how far down a ranking counts.
RRF_K, DEPTH = 60, 30
MODES = ("hybrid", "bm25", "dense")


def fuse(rankings: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """rankings(query_id, id, rank) by name to query_id, id, score and a rank column for each; ties go to the earlier rankings' hits."""
    marked = [r.select("query_id", "id", F.lit(name).alias("by"), "rank") for name, r in rankings.items()]
    every = reduce(DataFrame.unionByName, marked)
    ranks = [F.max(F.when(F.col("by") == name, F.col("rank"))).alias(f"{name}_rank") for name in rankings]
    return every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), *ranks)


def ranked(fused: DataFrame, names: list[str], top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(F.asc_nulls_last(f"{n}_rank") for n in names), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def filters(kind: str | None = None, source: str | None = None) -> Column | None:
    """Both conditions, those that are given; none is no filter."""
    tests = [F.col(c) == v for c, v in (("kind", kind), ("source", source)) if v]
    return reduce(Column.__and__, tests) if tests else None


def resolve_mode(mode: str, embedder_name: str) -> str:
    """auto: fuse where the embedder knows spelling only, else trust it alone. Any other mode must be known."""
    if mode == "auto":
        return "hybrid" if embedder_name.startswith("hashing:") else "dense"
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    return mode


@dataclass
class Retriever:
    """An index to search in any mode: lexical postings with kind and source, vectors(id, ordinal, v, kind, source), an embedder."""

    index: lexical.LexicalIndex
    vectors: DataFrame
    embedder: dense.Embedder

    def search(self, queries: DataFrame, top_k: int = 5, mode: str = "hybrid", where: Column | None = None, depth: int = DEPTH, within: str | None = None) -> DataFrame:
        """query_id, id, score, bm25_rank, dense_rank, rank. Each ranking counts to its depth, whatever top_k is.

        within: a kept column that must equal the query's own column ``within``.
        """
        mode = resolve_mode(mode, self.embedder.name)
        return self._fused(self._rankings(queries, (mode,), where, depth, within), mode, top_k)

    def search_modes(self, queries: DataFrame, top_k: int, modes: tuple[str, ...], where: Column | None = None, depth: int = DEPTH, within: str | None = None) -> dict[str, DataFrame]:
        """What search finds in each mode; each ranking is made once and written, whatever number of modes has it."""
        modes = tuple(resolve_mode(m, self.embedder.name) for m in modes)
        made = {n: materialize(r, n) for n, r in self._rankings(queries, modes, where, depth, within).items()}
        return {m: self._fused(made, m, top_k) for m in modes}

    def _rankings(self, queries: DataFrame, modes: tuple[str, ...], where: Column | None, depth: int, within: str | None) -> dict[str, DataFrame]:
        found = {}
        if any(m in ("hybrid", "bm25") for m in modes):
            found["bm25"] = lexical.search(self.index, queries, depth, where, within)
        if any(m in ("hybrid", "dense") for m in modes):
            asked = queries.select("query_id", self.embedder.queries(F.col("q")).alias("v"), *(["within"] if within else []))
            found["dense"] = dense.nearest(self.vectors, asked, depth, where, within)
        return found

    def _fused(self, rankings: dict[str, DataFrame], mode: str, top_k: int) -> DataFrame:
        own = {n: r for n, r in rankings.items() if mode in ("hybrid", n)}
        found = ranked(fuse(own), list(own), top_k)
        absent = [F.lit(None).cast("int").alias(f"{n}_rank") for n in ("bm25", "dense") if n not in own]
        return found.select("*", *absent).select("query_id", "id", "score", F.col("bm25_rank").cast("int"), F.col("dense_rank").cast("int"), "rank")


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks; ids that no chunk has fall out after the cut, so there may be fewer than asked."""
    return hits.join(chunks.withColumnRenamed("chunk_id", "id"), "id").withColumnRenamed("id", "chunk_id")


def format_hits(hits: DataFrame) -> DataFrame:
    """query_id, text of hits(query_id, rank, chunk_id, citation, article_title, body); join it left to the queries for those without hits."""
    head = F.concat(F.lit("["), "chunk_id", F.lit("] "), "citation", F.when(F.col("article_title") != "", F.concat(F.lit(" — "), "article_title")).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat(head, F.lit("\n"), "body").alias("t"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n---\n\n").alias("text"))


NO_HITS = "No matching provisions found."


def formatted(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return queries.select("query_id").join(format_hits(hits), "query_id", "left").select("query_id", F.coalesce("text", F.lit(NO_HITS)).alias("text"))
