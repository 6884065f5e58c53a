"""Legal markdown: files to lines, and texts to files."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.text import split_lines
from strandlake.staging import fs_path


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """source (the file's stem), value (its whole text) of each ``*.md`` file of a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(F.regexp_replace(F.url_decode(name), r"\.md$", "").alias("source"), "value")


def lines_of(texts: DataFrame) -> DataFrame:
    """texts(source, value) to source, pos, line."""
    return texts.select("source", F.posexplode(split_lines(F.col("value"))).alias("pos", "line"))


def write_markdown(texts: DataFrame, folder: str) -> None:
    """A file ``<source>.md`` in the folder for each row of texts(source, value), such as read_markdown reads; it ends in one newline.

    Spark writes folders, so texts are written beside and their files moved to their names: only names pass through the driver. A
    file of that name is replaced.
    """
    spark, folder = texts.sparkSession, folder.rstrip("/")
    beside = f"{folder}/_writing-{uuid.uuid4().hex}"
    lines = texts.select("source", F.regexp_replace("value", r"\n\z", "").alias("value"))
    lines.repartition("source").write.partitionBy("source").option("lineSep", "\n").text(beside)
    fs, written = fs_path(spark, beside)
    try:
        for each in fs.listStatus(written):
            key, _, name = each.getPath().getName().partition("=")
            if key != "source":
                continue
            target = fs_path(spark, f"{folder}/{unquote(name).replace('/', '%2F')}.md")[1]
            (part,) = [f.getPath() for f in fs.listStatus(each.getPath()) if f.getPath().getName().startswith("part-")]
            fs.delete(target, True)
            if not fs.rename(part, target):
                raise OSError(f"{target} could not be written")
    finally:
        fs.delete(written, True)
