"""What a run leaves: report, transcript, log and checks as files, and files that a model wrote, by their base names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.text import snippet


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def file_text(files: Column, name: str) -> Column:
    """The text of a file from map<string, struct<content, encoding>>: the exact name, without or with a leading slash, or any path that ends in it."""
    bare = name.lstrip("/")
    last = bare.rsplit("/", 1)[-1]
    same = F.filter(F.map_entries(files), lambda e: basename(e["key"]) == last)
    found = [F.try_element_at(files, F.lit(k)) for k in (name, bare, f"/{bare}")]
    return F.coalesce(*(x["content"] for x in found), F.try_element_at(F.array_sort(same), F.lit(1))["value"]["content"])


def plain_files(files: Column) -> Column:
    """map<string, string> (texts that were given bare) in the shape of files."""
    return F.transform_values(files, lambda _, v: F.struct(v.alias("content"), F.lit("utf-8").alias("encoding")))


def flattened(files: DataFrame, key: str = "run_id") -> DataFrame:
    """key, name, content of each file under its base name; of paths with one base name the last one stays."""
    each = files.select(key, F.explode("files").alias("path", "file")).select(key, "path", basename(F.col("path")).alias("name"), F.col("file.content").alias("content"))
    return each.where("name <> ''").groupBy(key, "name").agg(F.max_by("content", "path").alias("content"))


def persist(run: DataFrame, path: str) -> None:
    """run(run_id, final_report, transcript, log array, report struct, files map) to folders below path, by run."""
    for column, folder in (("final_report", "report"), ("transcript", "transcript")):
        run.select("run_id", F.coalesce(column, F.lit("")).alias("value")).write.mode("overwrite").partitionBy("run_id").text(f"{path}/{folder}")
    run.select("run_id", F.inline("log")).write.mode("overwrite").partitionBy("run_id").json(f"{path}/retrieval_log")
    run.select("run_id", "report.*").write.mode("overwrite").partitionBy("run_id").json(f"{path}/citation_report")
    flattened(run.select("run_id", F.col("files"))).select("run_id", "name", F.col("content").alias("value")).write.mode("overwrite").partitionBy("run_id", "name").text(f"{path}/research_files")


def hit_table(hits: DataFrame) -> DataFrame:
    """Hits as they are shown: rank, id, citation, both ranks, a snippet."""
    return hits.select("query_id", "rank", "chunk_id", "citation", "bm25_rank", "dense_rank", snippet(F.col("body")).alias("snippet")).orderBy("query_id", "rank")
