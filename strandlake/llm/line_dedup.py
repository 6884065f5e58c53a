"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased. The line table has one row
(key hash of 128 bits, document) for each key of a document that is long enough; the reference table counts documents by
key and knows the largest one. Keys with enough documents go into cuckoo filters, sharded by key hash, which sort out
nearly all lines before the exact join; a false positive costs a lookup and never a line. Deleting a document lowers the
counts and removes fingerprints, so the state is that of a corpus that never had it.

Defined cases: null or empty text is one empty line; a null doc_id takes no part (its row comes back unchanged); rows
that share a doc_id are one document for the counts; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import in_turn, keep_in_worker, materialize, scratch, table

BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MIN_CHARS = 20
MIN_DOCS = 3
KEYS_PER_SHARD = 50_000
#: The filters of all shards are broadcast up to this size; beyond it lines go to their shard's filter.
FILTER_BYTES = 64 << 20
#: Keys of one shard that a task looks up; a shard with more lines has them in several tasks, each with the filter.
LOOKUPS = 1_000_000
#: Share of a filter's cells beyond which inserts rebuild it with more room.
MOST_LOAD = 0.8

LINES = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "h1", "h2")])


def line_keys(text: bytes | None) -> list[bytes]:
    return [x.strip(BLANK) for x in (text or b"").translate(LOWER).split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    """At least so many code points; bytes bound them from both sides."""
    n = len(key)
    return n >= 4 * least or (n >= least and len(key.decode("utf-8", "replace")) >= least)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document and distinct long key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_in_worker("lines", lambda: None)
        digest = xxhash.xxh3_128_digest
        for b in in_turn(batches):
            ids, found, owner = b.column(0).to_pylist(), [], []
            for doc, text in zip(ids, _bytes(b.column(1)), strict=True):
                if doc is None or not text:
                    continue
                keys = {digest(k) for k in line_keys(text) if long_enough(k, min_chars)}
                found.extend(keys)
                owner.extend([doc] * len(keys))
            h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LINES)


def reference_counts(lines: DataFrame) -> DataFrame:
    """Documents by key, and the largest of them; a hot key is counted where its rows are before anything is sent."""
    return lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each key has two buckets, found from one another by the fingerprint.

    Inserts and lookups are vectorised. Equal keys are stored once for each insert, so a delete removes one of them.
    """

    SLOTS = 4

    def __init__(self, n_buckets: int, cells: np.ndarray | None = None) -> None:
        assert n_buckets & (n_buckets - 1) == 0
        self.n, self.cells = n_buckets, np.zeros((n_buckets, self.SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        n = 1 << max(4, int(np.ceil(np.log2(max(1, len(h1)) / (0.8 * cls.SLOTS)))))
        while True:
            made = cls(n)
            if made.insert(h1, h2):
                return made
            n *= 2

    @classmethod
    def load(cls, payload: bytes) -> CuckooFilter:
        cells = np.frombuffer(payload, np.uint16).reshape(-1, cls.SLOTS)
        return cls(len(cells), cells)

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (h2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (h2.view(np.uint64) & np.uint64(self.n - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, place: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return place ^ ((print_.astype(np.int64) * 0x5BD1E995) & (self.n - 1))

    def _fill(self, place: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """Put prints where their bucket has room; tells which found none."""
        order = np.argsort(place, kind="stable")
        p, start = place[order], np.r_[True, np.diff(place[order]) != 0]
        rank = np.arange(len(p)) - np.maximum.accumulate(np.where(start, np.arange(len(p)), 0))
        free = self.cells[p] == 0
        slot = np.argmax(free & (np.cumsum(free, axis=1) == (rank + 1)[:, None]), axis=1)
        fits = free.sum(axis=1) > rank
        self.cells[p[fits], slot[fits]] = print_[order][fits]
        left = np.ones(len(p), bool)
        left[order[fits]] = False
        return left

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        if not len(h1):
            return True
        print_, a, b = self._places(h1, h2)
        left = self._fill(a, print_)
        print_, b = print_[left], b[left]
        if len(print_):
            left = self._fill(b, print_)
            print_, b = print_[left], b[left]
        for f, at in zip(print_.tolist(), b.tolist(), strict=True):
            for kick in range(500):
                row = self.cells[at]
                empty = np.flatnonzero(row == 0)
                if len(empty):
                    row[empty[0]] = f
                    break
                k = (kick * 7 + f) % self.SLOTS
                f, row[k] = int(row[k]), f
                at = int(self._other(np.array([at]), np.array([f], np.uint16))[0])
            else:
                return False
        return True

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(h1, h2)
        return ((self.cells[a] == print_[:, None]) | (self.cells[b] == print_[:, None])).any(axis=1)

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        self.cells = self.cells.copy()
        for f, a, b in zip(*(x.tolist() for x in self._places(h1, h2)), strict=True):
            for at in (a, b):
                hit = np.flatnonzero(self.cells[at] == f)
                if len(hit):
                    self.cells[at, hit[0]] = 0
                    break


def filter_shards(repeated: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """A cuckoo filter for each shard of the repeated keys; a shard holds about KEYS_PER_SHARD of them, whatever their number."""
    shards = 1 << max(0, int(np.ceil(np.log2(max(1, n_keys) / KEYS_PER_SHARD))))
    return _built(repeated.select("h1", "h2", F.col("h1").bitwiseAND(F.lit(shards - 1)).alias("shard"))), shards


def _built(keyed: DataFrame) -> DataFrame:
    """A filter for each shard of keyed(h1, h2, shard)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(pdf["h1"].to_numpy(), pdf["h2"].to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "cells": [made.dump()]})

    return keyed.groupBy("shard").applyInPandas(build, "shard long, cells binary")


def probable(lines: DataFrame, shards: DataFrame, n_shards: int, n_keys: int) -> DataFrame:
    """Lines whose key may be repeated: all that are, and few others.

    Filters that are small together go to all tasks. Larger ones meet the lines of their shard, which are dealt over salts, as one
    key may have a third of them: a filter comes first in each of its groups and then the lines go by it.
    """
    if n_keys * 8 <= FILTER_BYTES:  # two bytes a slot, at least 0.4 full after rounding up
        cells = lines.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["cells"]) for r in shards.collect()})
        return lines.select("doc_id", "h1", "h2").mapInArrow(_looked_up(cells, n_shards), LINES)
    keyed = lines.select("doc_id", "h1", "h2", F.col("h1").bitwiseAND(F.lit(n_shards - 1)).alias("shard"))
    salts = keyed.groupBy("shard").agg(F.ceil(F.count("*") / LOOKUPS).cast("int").alias("salts"))
    most = salts.agg(F.max("salts")).first()[0] or 1
    held = shards.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("salt"), "cells")
    none = F.lit(None).cast("long")
    filters = held.select("shard", "salt", F.lit(0).alias("part"), none.alias("doc_id"), none.alias("h1"), none.alias("h2"), "cells")
    asked = keyed.select("shard", F.pmod(F.xxhash64("doc_id", "h2"), F.lit(most)).cast("int").alias("salt"), F.lit(1).alias("part"), "doc_id", "h1", "h2", F.lit(None).cast("binary").alias("cells"))
    met = filters.unionByName(asked).repartition(n_shards * most, "shard", "salt").sortWithinPartitions("shard", "salt", "part")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, None
        for b in parts:
            shard, salt, first = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edge = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | (first[1:] != first[:-1])])
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), b.num_rows], strict=True):
                key = (int(shard[lo]), int(salt[lo]))
                if first[lo] == 0:
                    now, found = key, CuckooFilter.load(b.column(6)[lo].as_py())
                elif key == now:  # a shard without a filter has no repeated key
                    s = b.slice(lo, hi - lo)
                    hit = found.contains(*(s.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)))
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([s.column(i).filter(pa.array(hit)) for i in (3, 4, 5)], ["doc_id", "h1", "h2"])

    return met.mapInArrow(run, LINES)


def _looked_up(cells, n_shards: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: CuckooFilter.load(v) for k, v in cells.value.items()}
        for b in parts:
            h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            hit, shard = np.zeros(len(h1), bool), h1 & (n_shards - 1)
            for k, f in filters.items():
                at = np.flatnonzero(shard == k)
                hit[at] = f.contains(h1[at], h2[at])
            if hit.any():
                yield b.filter(pa.array(hit))

    return run


def lines_to_drop(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id and the packed hashes of its keys that go: those of repeated keys, but for the largest document's."""
    repeated = materialize(reference_counts(lines).where(F.col("n") >= min_docs), "line-refs")
    n_keys = repeated.count()
    shards, n_shards = filter_shards(repeated, n_keys)
    hits = probable(lines, shards, n_shards, n_keys)
    gone = hits.join(repeated, ["h1", "h2"]).where(F.col("doc_id") < F.col("last"))
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def _rewrite(docs: DataFrame, drops: DataFrame, digest: bool, least: int = MIN_CHARS) -> DataFrame:
    """Apply drops. digest: doc_id, n_lines, n_dropped and the hash of what is kept; else the documents with their kept text."""
    carried = F.struct(*(F.lit(None).cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns)) if not digest else F.struct(F.col("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"), carried.alias("__row"))
    joined = rows.join(drops, "doc_id", "left").select("__text", "gone", "__row")
    row = joined.schema["__row"].dataType
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]) if digest else T.StructType([T.StructField("__row", row), T.StructField("__text", T.StringType())])

    def kept(text: bytes | None, gone: pa.Scalar) -> tuple[int, int, bytes]:
        lines = (text or b"").split(b"\n")
        if not gone.is_valid:
            return len(lines), 0, text or b""
        v = gone.values
        drop = set(np.stack([v.field(0).to_numpy(), v.field(1).to_numpy()], axis=1).astype("<i8").view("V16").ravel().tolist())
        left = [x for x, k in zip(lines, line_keys(text), strict=True) if len(k) < least or xxhash.xxh3_128_digest(k) not in drop]
        return len(lines), len(lines) - len(left), b"\n".join(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_turn(batches):
            got = [kept(t, g) for t, g in zip(_bytes(b.column("__text")), b.column("gone"), strict=True)]
            if digest:
                columns = [b.column("__row").field(0).cast(pa.int64()), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in got])]
            else:
                null = b.column("__text").is_null().to_pylist()
                columns = [b.column("__row"), pa.array([None if n and not x[1] else x[2].decode() for x, n in zip(got, null, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in out])

    done = joined.mapInArrow(run, out)
    return done if digest else done.select(*(F.col("__text").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, with the same columns, without their repeated lines."""
    lines = materialize(line_table(docs, min_chars), "lines")
    return _rewrite(docs, lines_to_drop(lines, min_docs), digest=False, least=min_chars)


class LineIndex:
    """Incremental line dedup over a growing corpus: the line table, reference counts and filters, all written tables.

    ``insert`` adds documents, ``delete`` takes documents out again, ``drops`` tells which lines go at present. Each call
    writes a new version beside the old one and then moves on to it, so that a failed call changes nothing.
    """

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> None:
        self.spark, self.min_chars, self.min_docs, self.root = spark, min_chars, min_docs, scratch(spark, "line-index")
        self.lines = spark.createDataFrame([], LINES)
        self.refs = spark.createDataFrame([], "h1 long, h2 long, n long, last long")
        self.shards, self.n_shards = spark.createDataFrame([], "shard long, cells binary"), 1

    def _move(self, lines: DataFrame, touched: DataFrame) -> None:
        """Counts are computed anew for touched keys only; filters gain keys that became repeated and lose those that ceased to be."""
        lines = materialize(lines, "index-lines")
        fresh = reference_counts(lines.join(touched, ["h1", "h2"], "left_semi"))
        refs = materialize(self.refs.join(touched, ["h1", "h2"], "left_anti").unionByName(fresh), "index-refs")
        was, now = (x.where(F.col("n") >= self.min_docs).select("h1", "h2") for x in (self.refs, refs))
        n_keys = now.count()
        if self.n_shards * KEYS_PER_SHARD * 2 < n_keys or not self.shards.take(1):
            shards, self.n_shards = filter_shards(now, n_keys)
        else:
            shards = self._edit(now.exceptAll(was).withColumn("up", F.lit(True)).unionByName(was.exceptAll(now).withColumn("up", F.lit(False))), now)
        self.shards, self.lines, self.refs = materialize(shards, "index-filters"), lines, refs

    def _edit(self, changes: DataFrame, repeated: DataFrame) -> DataFrame:
        """The filters after the changes; those that get too full are built anew, with more room, from all repeated keys."""
        n = self.n_shards

        def edit(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            shard = int((old if len(old) else new)["shard"].iloc[0])
            f = CuckooFilter.load(bytes(old["cells"].iloc[0])) if len(old) else CuckooFilter(1 << 16)
            up, down = new[new["up"]] if len(new) else new, new[~new["up"].astype(bool)] if len(new) else new
            f.delete(down["h1"].to_numpy(np.int64), down["h2"].to_numpy(np.int64))
            room = np.count_nonzero(f.cells) + len(up) <= MOST_LOAD * f.cells.size or not len(up)
            fits = room and f.insert(up["h1"].to_numpy(np.int64), up["h2"].to_numpy(np.int64))
            return pd.DataFrame({"shard": [shard], "cells": [f.dump() if fits else None]})

        shard = F.col("h1").bitwiseAND(F.lit(n - 1))
        keyed = changes.withColumn("shard", shard)
        edited = materialize(self.shards.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(edit, "shard long, cells binary"), "index-edited")
        full = edited.where("cells IS NULL").select("shard")
        return edited.where("cells IS NOT NULL").unionByName(_built(repeated.withColumn("shard", shard).join(F.broadcast(full), "shard")))

    def insert(self, docs: DataFrame) -> None:
        new = materialize(line_table(docs, self.min_chars), "index-new")
        self._move(self.lines.unionByName(new).distinct(), new.select("h1", "h2").distinct())

    def delete(self, doc_ids: DataFrame) -> None:
        ids = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        touched = self.lines.join(ids, "doc_id", "left_semi").select("h1", "h2").distinct()
        self._move(self.lines.join(ids, "doc_id", "left_anti"), touched)

    def drops(self) -> DataFrame:
        """doc_id, h1, h2 of each line key that a document loses at present."""
        repeated = self.refs.where(F.col("n") >= self.min_docs)
        hits = probable(self.lines, self.shards, self.n_shards, repeated.count())
        return hits.join(repeated, ["h1", "h2"]).where(F.col("doc_id") < F.col("last")).select("doc_id", "h1", "h2")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = materialize(line_table(docs), "lines")
    return _rewrite(docs, lines_to_drop(lines), digest=True)


ORACLE = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, pos, ls[pos] AS line,
         translate(trim(ls[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM docs)),
rep AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, (r.k IS NOT NULL AND l.doc_id <> r.last) AS gone FROM lines l LEFT JOIN rep r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
