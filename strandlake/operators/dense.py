"""Vectors: embedders, and nearest neighbours by cosine, exact or by an index of cells.

An embedder has a name and makes arrays of doubles from a text column, in Arrow batches that are cut into slices, so that a worker
holds the vectors of a slice. Neighbours are exact: each task multiplies tiles of its vectors and of the queries, keeps the k best of
each query while it reads, and hands these on, so what it holds and what is shuffled grow with queries and not with pairs.
Queries that are few go to every task; more of them are written in blocks of bounded size, and vectors meet each block in groups of
tasks. Vectors and queries that are null, empty or hold non-finite components have no neighbours.

CellIndex is the approximate way: centres are learned from a bounded sample, each vector lies in the cell of its nearest centre, and a
query looks into the cells nearest to it.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.text import MOST_DELAY, RETRY_HINT
from strandlake.operators.best import Best
from strandlake.operators.lexical import DIGITS

#: Bytes of query vectors that go to every task at once, and that a block of more queries has, about.
QUERY_BYTES = 32 << 20
#: Vectors that one group of a block of queries is compared with, about.
GROUP_VECTORS = 200_000
#: Queries and vectors of a tile, which are compared at once.
TILE = (2048, 512)
#: Texts that are embedded at once, and bytes of them that are hashed at once.
SLICE, AT_ONCE = 256, 1 << 19


class Embedder(Protocol):
    """name tells vectors of different makers apart; dim is their length."""

    name: str
    dim: int

    def documents(self, text: Column) -> Column: ...

    def queries(self, text: Column) -> Column: ...


class HashingEmbedder:
    """Signed hashed counts of 3- to 5-character runs of marked tokens, of unit length."""

    def __init__(self, dim: int = 1024) -> None:
        self.dim, self.name = dim, f"hashing:char3-5:{dim}"

    def documents(self, text: Column) -> Column:
        return F.arrow_udf(_hashed(self.dim), T.ArrayType(T.DoubleType()))(text)

    queries = documents


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()
#: Bytes of a lower-cased text: letters and digits as they are, all others as marks between tokens.
_MARKED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else ord("#") for c in range(256))


def hashed_counts(texts: list[str | None], dim: int) -> np.ndarray:
    """Of each text the signed count of each bucket, over the runs of 3 to 5 characters of its marked tokens.

    Runs are cut and hashed (CRC-32) over the bytes of all texts at once; a run may begin and end with a mark but holds none inside.
    """
    marked = [b"#" + (t or "").lower().encode("utf-8", "replace").translate(_MARKED) + b"#" for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(m) for m in marked])
    every = np.frombuffer(b"".join(marked), np.uint8)
    out = np.zeros(len(texts) * 2 * dim, np.int64)
    for lo in range(0, len(every), AT_ONCE):
        b = every[lo : lo + AT_ONCE + 4]
        token = b != ord("#")
        at = np.flatnonzero(token[1 : AT_ONCE + 1])[: AT_ONCE]  # runs whose second character is one of a token
        state = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for n in range(5):
            at, state = (at[at + n < len(b)], state[at + n < len(b)])
            if n > 2:
                inside = token[at + n - 1]
                at, state = at[inside], state[inside]
            state = _CRC[(state ^ b[at + n]) & 255] ^ (state >> 8)
            if n >= 2:
                h = ~state
                out += np.bincount((row[lo + at] * dim + h % dim) * 2 + ((h >> 16) & 1), minlength=len(out))
    out = out.reshape(len(texts), dim, 2)
    return out[:, :, 1] - out[:, :, 0]


def bucket_counts(texts: DataFrame, dim: int) -> DataFrame:
    """texts(id, text) to id, bucket, value: what a HashingEmbedder normalises, the signed count of each bucket that is not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                counts = hashed_counts(b.column(1).to_pylist(), dim)
                row, bucket = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(bucket), pa.array(counts[row, bucket])], ["id", "bucket", "value"])

    return texts.select("id", "text").mapInArrow(run, T.StructType([texts.schema["id"], T.StructField("bucket", T.LongType()), T.StructField("value", T.LongType())]))


def _hashed(dim: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for lo in range(0, max(1, len(texts)), SLICE):
                some = texts.slice(lo, SLICE)
                v = hashed_counts(some.to_pylist(), dim).astype(float)
                v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), pa.array(v.ravel()))

    return run


_queries_kept: dict[tuple[str, str], dict[str, np.ndarray]] = {}


def seconds_to_wait(message: str, attempt: int) -> float:
    """What functions.text.retry_delay says of a column, for a caller in a task."""
    hint = re.search(RETRY_HINT, message)
    try:
        return float(hint[1]) + 1 if hint else min(2.0**attempt, MOST_DELAY)
    except ValueError:
        return min(2.0**attempt, MOST_DELAY)


class RemoteEmbedder:
    """A hosted model behind a function of a list of texts and a task; answers are normalised and asked for in batches.

    The function must be safe to pickle. A batch that fails is asked for again after the wait that the message tells, or a growing
    one; a process keeps the vectors of queries, so that one that is repeated is not asked for again.
    """

    BATCH, TRIES, MOST_KEPT = 100, 5, 10_000

    def __init__(self, model: str, dim: int, call: Callable[[list[str], str], list[list[float]]], wait: Callable[[float], None] = time.sleep) -> None:
        self.model, self.dim, self.call, self.name, self.wait = model, dim, call, f"remote:{model}:{dim}", wait

    def _asked(self, some: list[str], task: str) -> list[np.ndarray]:
        for k in range(self.TRIES):
            try:
                got = self.call(some, task)
                break
            except Exception as e:
                if k == self.TRIES - 1:
                    raise
                self.wait(seconds_to_wait(str(e), k))
        if len(got) != len(some):
            raise ValueError(f"{len(got)} vectors for {len(some)} texts")
        return [(v := np.asarray(x, float)) / (np.sqrt(v @ v) or 1.0) for x in got]

    def vectors(self, texts: list[str], task: str) -> list[np.ndarray]:
        """Of queries each is asked for once, as long as it is kept."""
        kept = _queries_kept.setdefault((self.name, task), {}) if task == "query" else {}
        wanted = list(dict.fromkeys(t for t in texts if t not in kept)) if task == "query" else texts
        found = [v for lo in range(0, len(wanted), self.BATCH) for v in self._asked(wanted[lo : lo + self.BATCH], task)]
        if task != "query":
            return found
        new = dict(zip(wanted, found, strict=True))
        out = [kept[t] if t in kept else new[t] for t in texts]
        if len(kept) + len(new) > self.MOST_KEPT:
            kept.clear()
        kept.update(list(new.items())[: self.MOST_KEPT])
        return out

    def _column(self, text: Column, task: str) -> Column:
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(self.vectors(texts.fillna("").tolist(), task))

        return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(text)

    def documents(self, text: Column) -> Column:
        return self._column(text, "document")

    def queries(self, text: Column) -> Column:
        return self._column(text, "query")


def default_embedder(call: Callable[[list[str], str], list[list[float]]] | None = None, model: str | None = None, dim: int = 768) -> Embedder:
    """The hosted model if a caller is given for it, else the one that needs nothing."""
    return RemoteEmbedder(model or os.environ.get("STRANDLAKE_EMBED_MODEL", "default"), dim, call) if call else HashingEmbedder()


def embed(docs: DataFrame, embedder: Embedder, text: str, name: str = "embedding") -> DataFrame:
    return docs.withColumn(name, embedder.documents(F.col(text)))


def usable(v: Column) -> Column:
    """Whether a vector has a direction to compare: some components, all of them finite."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _unit(v: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, of unit length; zeros stay."""
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(float)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, within: str | None = None) -> DataFrame:
    """vectors(id, ordinal, v) and queries(query_id, v) to query_id, id, ordinal, score, rank: the k most alike of each query.

    within: a column of the vectors that must equal the query's own column ``within``; it is a part of the key that both are compared by.
    """
    kept = vectors if where is None else vectors.where(where)
    key = F.xxhash64(within).alias("key") if within else F.lit(0).cast("long").alias("key")
    # what is no vector falls out where vectors are compared
    kept = kept.select(F.col("id"), F.col("ordinal").cast("long"), F.col("v").cast("array<double>"), key)
    key = F.xxhash64("within").alias("key") if within else F.lit(0).cast("long").alias("key")
    asked = queries.select(F.col("query_id").cast("long"), F.col("v").cast("array<double>"), key).where(usable(F.col("v")))
    n, size = asked.agg(F.count("*"), F.sum(F.size("v") * 8)).first()
    if not n:
        return _ranked(vectors.sparkSession.createDataFrame([], _hit_schema(kept)), k)
    if size <= QUERY_BYTES:
        alike: dict[tuple[int, int], tuple[list, list]] = {}
        for r in asked.orderBy("query_id").toLocalIterator():
            names, rows = alike.setdefault((r["key"], len(r["v"])), ([], []))
            names.append(r["query_id"])
            rows.append(r["v"])
        given = vectors.sparkSession.sparkContext.broadcast({d: (np.array(names, np.int64), _normal(np.array(rows))) for d, (names, rows) in alike.items()})
        return _ranked(kept.mapInArrow(_best(given, k), _hit_schema(kept)), k)
    # each block of queries meets each group of vectors in a task of its own
    blocks, groups = -(-size // QUERY_BYTES), -(-kept.count() // GROUP_VECTORS) or 1
    q = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("part"), "query_id", F.lit(None).cast(kept.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("ordinal"), "v", "key")
    x = kept.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("part"), F.lit(None).cast("long").alias("query_id"), "id", "ordinal", "v", "key")
    met = q.unionByName(x).repartition("block", "group").sortWithinPartitions("block", "group", "part")
    return _ranked(met.mapInArrow(_best_in_groups(k), _hit_schema(kept)), k)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _hit_schema(kept: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", T.LongType()), kept.schema["id"], T.StructField("ordinal", T.LongType()), T.StructField("score", T.DoubleType())])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _add(best: Best, part: pa.RecordBatch, q: np.ndarray) -> None:
    """A batch of vectors of one length meets the queries, tile by tile; what can't be among a query's k best any more goes no further."""
    for lo in range(0, part.num_rows, TILE[1]):
        some = part.slice(lo, TILE[1])
        v = some.column("v")
        finite = np.isfinite(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(float)).all(axis=1)
        if not finite.all():
            some = some.filter(pa.array(finite))
        if not some.num_rows:
            continue
        x, ids, ordinals = _unit(some.column("v")).T, some.column("id"), some.column("ordinal")
        for first in range(0, len(q), TILE[0]):
            s = q[first : first + TILE[0]] @ x
            floor = best.floor[first : first + len(s)]
            if np.isneginf(floor).any() and s.shape[1] > best.k:
                # the worst that can be among the tile's own k best, and what rounds to it
                floor = np.maximum(floor, np.partition(s, -best.k, axis=1)[:, -best.k])
            i, j = np.nonzero(s >= (floor - 2 * 10.0**-DIGITS)[:, None])
            score = np.round(s[i, j], DIGITS)
            good = np.flatnonzero(score >= best.floor[first + i])
            at = pa.array(j[good])
            best.add(first + i[good], ids.take(at), ordinals.take(at), score[good])


def _alike(b: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Rows that can be compared: of one key and one length, which is not 0."""
    lengths, keys = b.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), b.column("key").to_numpy(zero_copy_only=False)
    found = np.unique(np.stack([keys, lengths.astype(np.int64)], axis=1), axis=0).tolist()
    for key, d in found:
        if d:
            yield (key, d), b if len(found) == 1 else b.filter(pa.array((lengths == d) & (keys == key)))


def _handed_on(found: dict[tuple[int, int], Best], given: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for d, best in found.items():
        out = best.table()
        if out is not None:
            yield from out.set_column(0, "query_id", pa.array(given[d][0][out.column(0).to_numpy()])).to_batches(max_chunksize=1 << 16)


def _best(given, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Best] = {}
        for b in batches:
            for d, part in _alike(b):
                if d in given.value:
                    _add(found.setdefault(d, Best(len(given.value[d][0]), k)), part, given.value[d][1])
        yield from _handed_on(found, given.value)

    return run


def _best_in_groups(k: int):
    """Rows in order of (block, group, part): queries first, and the vectors after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready, found = None, {}, {}, {}
        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "group", "part")], axis=1)
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                if tuple(key[lo, :2]) != now:
                    yield from _handed_on(found, ready)
                    now, held, ready, found = tuple(key[lo, :2]), {}, {}, {}
                for d, s in _alike(part):
                    if key[lo, 2] == 0:
                        held.setdefault(d, []).append((s.column("query_id").to_numpy(zero_copy_only=False), _unit(s.column("v"))))
                    elif d in held:
                        if d not in ready:
                            ready[d] = tuple(np.concatenate(x) for x in zip(*held[d], strict=True))
                            found[d] = Best(len(ready[d][0]), k)
                        _add(found[d], s, ready[d][1])
        yield from _handed_on(found, ready)

    return run


class CellIndex:
    """Approximate neighbours: the cells of centres that spherical k-means finds in a sample.

    SAMPLE bounds the sample that centres are learned from; every vector is in the index, in one cell. A cell's rows are files of their
    own, so that a search reads the cells that its queries look into and no others. probes of them trade time for recall; the test
    measures it against exact neighbours.
    """

    SAMPLE, ROUNDS = 50_000, 12

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, cells: int = 256, seed: int = 11) -> None:
        """vectors(id, ordinal, v, ...) of one length; other columns are kept for filters."""
        good = vectors.where(usable(F.col("v")))
        n = good.count()
        share = min(1.0, self.SAMPLE / max(1, n))
        some = good.select("v").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(2 * self.SAMPLE)
        made = some.select(F.col("v").cast("array<double>")).repartition(1).mapInArrow(_centres(cells, self.ROUNDS, seed), "cell int, centre array<double>")
        made.write.mode("overwrite").parquet(f"{self.path}/centres")
        given = self.spark.sparkContext.broadcast(self._centres_kept())
        placed = good.withColumn("cell", F.pandas_udf(_nearest_cell(given), T.IntegerType())("v"))
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors")

    def _centres_kept(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # as many as cells
        return np.array([r["centre"] for r in rows], float)

    def search(self, queries: DataFrame, k: int, probes: int = 16, where: Column | None = None) -> DataFrame:
        """query_id, id, ordinal, score, rank. Queries meet the rows of their cells by an equal join, so that any number of them may be asked."""
        given = self.spark.sparkContext.broadcast(self._centres_kept())
        asked = queries.where(usable(F.col("v"))).select(F.col("query_id").cast("long"), F.col("v").cast("array<double>").alias("q"))
        looks = asked.withColumn("cell", F.explode(F.pandas_udf(_cells_of(given, probes), T.ArrayType(T.IntegerType()))("q")))
        kept = self.spark.read.parquet(f"{self.path}/vectors")
        kept = kept if where is None else kept.where(where)
        wanted = [r["cell"] for r in looks.select("cell").distinct().collect()]  # as many as cells
        met = kept.where(F.col("cell").isin(wanted)).select("cell", "id", F.col("ordinal").cast("long"), F.col("v").cast("array<double>").alias("v")).join(looks, "cell")
        scored = met.select("query_id", "id", "ordinal", F.pandas_udf(_cosines, T.DoubleType())("q", "v").alias("score"))
        return _ranked(scored, k)


def _centres(cells: int, rounds: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [_unit(b.column("v")) for b in batches if b.num_rows]
        if not rows:
            return
        x = np.concatenate(rows)
        x = x[np.lexsort(x.T[:3])]  # in whatever order they came
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            at = np.concatenate([np.argmax(x[lo : lo + 8192] @ c.T, axis=1) for lo in range(0, len(x), 8192)])
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            empty = np.bincount(at, minlength=len(c)) == 0
            sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
            c = _normal(sums)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(list(c), pa.list_(pa.float64()))], ["cell", "centre"])

    return run


def _nearest_cell(given) -> Callable[[pd.Series], pd.Series]:
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(np.stack(v.to_numpy()).astype(float) @ given.value.T, axis=1) if len(v) else [], dtype="int32")

    return run


def _cells_of(given, probes: int) -> Callable[[pd.Series], pd.Series]:
    def run(v: pd.Series) -> pd.Series:
        near = np.argsort(-(np.stack(v.to_numpy()).astype(float) @ given.value.T), axis=1, kind="stable")[:, :probes] if len(v) else []
        return pd.Series([r.astype(np.int32) for r in near])

    return run


def _cosines(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = _normal(np.stack(a.to_numpy())), _normal(np.stack(b.to_numpy()))
    return pd.Series(np.round(np.einsum("ij,ij->i", x, y), DIGITS))
