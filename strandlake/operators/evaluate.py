"""Retrieval quality: recall at depths and mean reciprocal rank, for all questions and by type, in one plan for all modes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTHS = (1, 3, 5)
DEPTH = 10


def first_relevant(cases: DataFrame, hits: DataFrame, relevant: Column) -> DataFrame:
    """cases(query_id, ...) and hits(query_id, mode, rank, ...) to each case's first relevant rank by mode, null where there is none.

    relevant is a test over columns of both; every case counts for every mode of the hits.
    """
    good = hits.join(cases, "query_id").where(relevant).groupBy("query_id", "mode").agg(F.min("rank").alias("rank"))
    modes = [r["mode"] for r in hits.select("mode").distinct().orderBy("mode").collect()]  # a few
    every = cases.withColumn("mode", F.explode(F.array(*map(F.lit, modes)).cast("array<string>")))
    return every.join(good, ["query_id", "mode"], "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """ranks(mode, type, rank) to grp, mode, n and measures; questions without a relevant hit count as missed."""
    typed = ranks.withColumn("type", F.coalesce("type", F.lit("paraphrase")))
    recall = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in DEPTHS]
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    sets = typed.groupingSets([["mode"], ["mode", "type"]], "mode", "type")
    return sets.agg(F.count("*").alias("n"), *recall, mrr).select(F.coalesce("type", F.lit("all")).alias("grp"), "mode", "n", *(f"recall_at_{k}" for k in DEPTHS), "mrr")


def misses(ranks: DataFrame, depth: int = 5) -> DataFrame:
    return ranks.where(F.col("rank").isNull() | (F.col("rank") > depth))


def unknown_labels(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labels that name no article of their source; none if the labels are sound."""
    labels = cases.select("query_id", "source", F.explode("articles").alias("article"))
    return labels.join(chunks.select("source", "article").distinct(), ["source", "article"], "left_anti")


def run(retriever, cases: DataFrame, chunks: DataFrame, modes: tuple[str, ...] = ("bm25", "dense", "hybrid"), depth: int = DEPTH) -> DataFrame:
    """query_id, mode, type, q, rank of cases(query_id, q, source, articles, type), each searched within the chunks of its source.

    All cases are one batch in each mode, whatever the number of sources: a case's source goes with it and meets the chunks' in the
    search, before ranks are cut.
    """
    found = retriever.search_modes(cases.select("query_id", "q", F.col("source").alias("within")), depth, modes, F.col("kind") == "regulation", within="source")
    hits = reduce(DataFrame.unionByName, [hits.withColumn("mode", F.lit(m)) for m, hits in found.items()]).join(chunks.select(F.col("chunk_id").alias("id"), "article"), "id")
    return first_relevant(cases, hits, F.array_contains("articles", F.col("article"))).select("query_id", "mode", "type", "q", "rank")
