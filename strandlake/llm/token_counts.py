"""Token counts by a separator scan over flat token files.

A token file holds little-endian ids of all its documents, each followed by the end-of-document id, and nothing else. Files
are read in blocks of fixed size by independent tasks; numpy finds the separators of a block at once. A prefix scan over the
block summaries (separators so far, end of the last one) gives each block its first document's number and start, so that
documents which span blocks, even many, come out whole. The scan is done in two levels, so that no window holds more than
SPAN blocks of one file.

Writing: each task writes one file under a name of its own into the shared folder and returns which document is where in it.
A task that is run again writes another file; only files named in the returned rows are scanned.

Defined cases: null or empty text has no tokens and still its separator; repeated rows are counted each; tokens after the last
separator of a file are a document without an end (``ended`` false); an empty file has none; an empty table gives no rows; the
strings of special tokens in a text are ordinary text, so that a text never holds the separator.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import in_turn, materialize, scratch, table
from strandlake.llm.token_ids import part_tokenizer, texts_of

TOKENIZER = "word_bpe_49k.json"
#: The tokenizer's own end-of-text id; ids fit two bytes.
SEPARATOR = 49407
ID_TYPE = "<u2"
BLOCK_BYTES = 8 << 20
#: Blocks of one file that a window of the prefix scan holds.
SPAN = 4096


def _open(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder's address, in the driver or in a task."""
    return FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, separator: int = SEPARATOR, id_type: str = ID_TYPE) -> DataFrame:
    """docs(doc_id, text) to doc_id, file, part, ordinal: the name of its file, the file's number, its place in it."""
    path = public_tokenizers.path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, done, out = part_tokenizer(path, special_as_text=True), TaskContext.get().partitionId(), 0, None
        name = f"{part:06d}-{uuid.uuid4().hex}.ids"
        end = np.array([separator], id_type).tobytes()
        try:
            for b in in_turn(batches):
                if not b.num_rows:
                    continue
                if out is None:
                    fs, at = _open(folder)
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}")
                for _, texts in texts_of(b.column(1)):
                    for ids in t.encode_all(texts):
                        out.write(ids.astype(id_type).tobytes() + end)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * n), pa.array([part] * n, pa.int32()), pa.array(range(done, done + n), pa.int64())], ["doc_id", "file", "part", "ordinal"])
                done += n
        finally:
            if out is not None:
                out.close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, file string, part int, ordinal long")


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes of each token file in a folder; contents aren't read."""
    fs, at = _open(folder)
    if fs.get_file_info(at).type != FileType.Directory:
        return spark.createDataFrame([], "file string, bytes long")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


BLOCKS = "file string, block long, first long, n long, ends array<int>"


def _blocks(files: DataFrame, folder: str, separator: int, id_type: str, block_bytes: int) -> DataFrame:
    """A row for each block: its number, the number of its first token, its tokens, and where in it separators are."""
    width = np.dtype(id_type).itemsize
    per_block = block_bytes // width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        for b in batches:
            for name, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{at}/{name}") as f:
                    f.seek(block * per_block * width)
                    ids = np.frombuffer(f.read(per_block * width), id_type)
                ends = np.flatnonzero(ids == separator).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([block * per_block]), pa.array([len(ids)]), pa.array([ends], pa.list_(pa.int32()))], ["file", "block", "first", "n", "ends"])

    cut = files.where(F.col("bytes") > 0).select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / (per_block * width)))).alias("block"))
    return cut.repartition("file", "block").mapInArrow(run, BLOCKS)


def scan_token_files(files: DataFrame, folder: str, separator: int = SEPARATOR, id_type: str = ID_TYPE, block_bytes: int = BLOCK_BYTES, span: int = SPAN) -> DataFrame:
    """files(file, bytes) to file, ordinal, start, n_tokens, ended of each document; separators don't count."""
    blocks = materialize(_blocks(files, folder, separator, id_type, block_bytes), "token-blocks")
    last = F.when(F.size("ends") > 0, F.col("first") + F.element_at("ends", -1))
    sums = blocks.select("file", "block", F.floor(F.col("block") / span).alias("span"), F.size("ends").alias("k"), last.alias("last"), (F.col("first") + F.col("n")).alias("upto"))
    spans = sums.groupBy("file", "span").agg(F.sum("k").alias("k"), F.max("last").alias("last"), F.max("upto").alias("upto"))
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("file", "span", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"), F.max("last").over(before).alias("last0"), (F.max("upto").over(Window.partitionBy("file"))).alias("total"))
    inside = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = sums.select("file", "block", "span", "upto", F.coalesce(F.sum("k").over(inside), F.lit(0)).alias("k1"), F.max("last").over(inside).alias("last1"))
    scan = within.join(carried, ["file", "span"]).select("file", "block", (F.col("k0") + F.col("k1")).alias("before"), (F.coalesce("last1", "last0", F.lit(-1)) + 1).alias("start0"), (F.col("upto") == F.col("total")).alias("final"))
    joined = blocks.join(scan, ["file", "block"])
    ends = F.transform("ends", lambda e: F.col("first") + e)
    starts = F.concat(F.array("start0"), F.transform(ends, lambda e: e + 1))
    closed = F.zip_with(F.slice(starts, F.lit(1), F.size("ends")), ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("n"), F.lit(True).alias("ended")))
    rest = F.col("first") + F.col("n") - F.element_at(starts, -1)
    open_ = F.when(F.col("final") & (rest > 0), F.array(F.struct(F.element_at(starts, -1).alias("start"), rest.alias("n"), F.lit(False).alias("ended")))).otherwise(F.array())
    found = joined.select("file", "before", F.posexplode(F.concat(closed, open_)).alias("pos", "doc"))
    return found.select("file", (F.col("before") + F.col("pos")).alias("ordinal"), F.col("doc.start").alias("start"), F.col("doc.n").alias("n_tokens"), F.col("doc.ended").alias("ended"))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, separator: int = SEPARATOR, id_type: str = ID_TYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, part, ordinal, start of each document, from token files that are written and scanned."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    held = materialize(write_token_files(docs, folder, tokenizer, separator, id_type), "token-places")
    files = file_sizes(spark, folder).join(held.select("file").distinct(), "file", "left_semi")
    found = scan_token_files(files, folder, separator, id_type, block_bytes)
    return held.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "part", "ordinal", "start")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
