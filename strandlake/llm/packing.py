"""Best-fit packing with certified bounds.

A document's tokens and an end token are cut into pieces of at most CAPACITY only where they are longer. Full pieces are
sequences of their own. The rest is dealt into partitions of bounded size; each is packed by best-fit decreasing, and
dual feasible functions give a lower bound on its number of sequences. Partitions that meet their bound are certified and
final. Of partitions with a gap, sequences that are full stay, and the documents of the others are exchanged: dealt out anew
over all such partitions and packed again. A last exchange joins the loosest sequence of every partition.

Defined cases: null text is empty (one piece, the end token); repeated rows are packed each; an empty table gives no
rows; ties in length go by doc_id and piece. Lengths and results carry no other columns than those named.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import in_turn, materialize, table
from strandlake.llm.token_ids import part_tokenizer, texts_of

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one partition packs; a partition of an exchange takes up to four times as many.
PER_PARTITION = 4096
EXCHANGES = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document; uid tells rows apart even where documents repeat."""
    path = public_tokenizers.path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = part_tokenizer(path)
        for b in in_turn(batches):
            ids, rows = b.column(0).to_pylist(), []
            for lo, texts in texts_of(b.column(1)):
                for doc, found in zip(ids[lo : lo + len(texts)], t.encode_all(texts), strict=True):
                    tokens = np.append(found, np.uint32(END)).astype("<u4")
                    for k in range(0, len(tokens), capacity):
                        part = tokens[k : k + capacity]
                        rows.append((doc, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES.rpartition(",")[0])
    return found.withColumn("uid", F.monotonically_increasing_id())


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of the lengths, which come in falling order. A bit for each free space finds the tightest bin."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, k, bins = capacity, bins, bins + 1
        place[i], offset[i] = k, capacity - room
        if left := room - n:
            free[left].append(k)
            mask |= 1 << left
    return place, offset


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of two families of dual feasible functions over all their parameters."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    best = -(-int(lengths.sum()) // capacity)
    # u: items above capacity - t count whole, items below t nothing, the others by their length
    n_above = np.r_[np.cumsum(count[::-1])[::-1], 0]
    s_above = np.r_[np.cumsum((count * np.arange(capacity + 1))[::-1])[::-1], 0]
    t = np.arange(1, capacity // 2 + 1)
    whole = n_above[capacity - t + 1]
    part = s_above[t] - s_above[capacity - t + 1]
    best = max(best, int(np.max(whole + -(-part // capacity))))
    # f: halves and above by the complement's multiples of k, others by their own
    distinct = np.flatnonzero(count)
    for k in np.unique(np.r_[distinct[distinct <= capacity // 2], [capacity // 2, capacity // 3, capacity // 4]]).tolist():
        if k < 1 or k < capacity // 64:
            continue
        all_, x = capacity // k, distinct
        value = np.where(2 * x > capacity, 2 * (all_ - (capacity - x) // k), np.where(2 * x == capacity, all_, 2 * (x // k)))
        best = max(best, int(-(-int((value * count[x]).sum()) // (2 * all_))))
    return best


def _pack(capacity: int, round_: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "uid"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        place, offset = best_fit(lengths.tolist(), capacity)
        bins = int(place.max()) + 1
        fill = np.bincount(place, weights=lengths, minlength=bins).astype(np.int64)
        loosest = place == int(np.argmin(fill))
        gap = bins > lower_bound(lengths, capacity)
        sequence = (round_ << 56) + (int(pdf["part"].iloc[0]) << 24) + place
        # with no gap all stays; a full sequence stays in any case
        again = (gap & (fill[place] < capacity)) | (loosest & (fill[place] < capacity))
        return pd.DataFrame({"uid": pdf["uid"], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "length": lengths, "sequence_id": sequence, "offset": offset, "again": again})

    return run


PLACED = "uid long, doc_id long, piece int, length long, sequence_id long, offset long, again boolean"


def place(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, exchanges: int = EXCHANGES) -> DataFrame:
    """items(uid, doc_id, piece, length) to uid, sequence_id, offset."""
    full = items.where(F.col("length") >= capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool, done = items.where(F.col("length") < capacity).select("uid", "doc_id", "piece", "length"), []
    n, best = pool.count(), None
    for k in range(exchanges + 1):
        if not n:
            break
        parts = max(1, round(n / (per_partition * (1 if not k else 4))))
        dealt = pool.withColumn("part", F.pmod(F.xxhash64(F.lit(k), "doc_id", "piece", "uid"), F.lit(parts)))
        packed = materialize(dealt.groupBy("part").applyInPandas(_pack(capacity, k), PLACED), f"packed-{k}")
        used = packed.agg(F.count_distinct(F.when(F.col("again"), F.col("sequence_id"))), F.count_distinct("sequence_id"), F.count_if("again")).first()
        if best is not None and used[1] >= best[0]:
            break  # no better than the packing that these documents have
        if best is not None:
            done[-1] = done[-1].where(~F.col("again"))
        done.append(packed)
        pool, n, best = packed.where("again").select("uid", "doc_id", "piece", "length"), used[2], (used[0],)
        if parts == 1:
            break
    for x in done:
        full = full.unionByName(x.select("uid", "sequence_id", "offset"))
    return full


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs(doc_id, text)."""
    cut = materialize(pieces(docs, tokenizer, capacity), "pieces")
    placed = place(cut, capacity)
    return cut.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
