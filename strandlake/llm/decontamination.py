"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one scan of each text.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Windows are 13 consecutive words of an
item; a shorter item with any words is one window. The automaton reads the words joined by single spaces and reports where
windows end; both the word and the byte offset in the original follow from the positions of the separators, because the
normalisation keeps every byte in its place.

The automaton goes to every task, so the benchmark's size is measured first: up to PART_CHARS it is one automaton; a
larger benchmark is cut into parts of that size, long items too, one part after another scans the texts, and hits are united by
document.

Defined cases: null or wordless text has no words and no hits; null or wordless items have no windows; repeated items
count once by item_id; repeated documents each get their row; items with null item_id are left out; other columns of documents pass
through whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import in_turn, keep_in_worker, materialize, rows_that_pass, table

WINDOW = 13
#: Characters of benchmark text for one automaton, about 0.5 GB of it at worst.
PART_CHARS = 2_000_000
#: Items of more characters are cut into runs of so many words, so that one item may be larger than a part.
SEGMENT_CHARS, SEGMENT_WORDS = 100_000, 10_000
_table = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B)]:
    _table[_c] = _c
for _c in range(0x41, 0x5B):
    _table[_c] = _c + 32
NORMAL = bytes(_table)


def words(text: bytes | None) -> list[bytes]:
    """bytes.split cuts at blanks only here: NORMAL leaves no other white space below 0x80, and none is above."""
    return (text or b"").translate(NORMAL).split()


def item_windows(items: list[tuple[int, bytes | None]]) -> list[tuple[str, int, tuple[int, ...]]]:
    """(pattern, its words, item_ids) for each different window; latin-1 strings stand for bytes."""
    found: dict[bytes, set[int]] = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            found[b" " + b" ".join(w[i : i + WINDOW]) + b" "].add(item)
    return [(k.decode("latin-1"), k.count(b" ") - 1, tuple(sorted(v))) for k, v in sorted(found.items())]


def automaton(windows: list[tuple[str, int, tuple[int, ...]]]) -> ahocorasick.Automaton | None:
    if not windows:
        return None
    made = ahocorasick.Automaton()
    for pattern, n, items in windows:
        made.add_word(pattern, (n, items))
    made.make_automaton()
    return made


def _covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of n words that some run from first up to last covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    return np.cumsum(change)[:-1] > 0


def scan(text: bytes | None, found: ahocorasick.Automaton | None) -> tuple[int, np.ndarray, np.ndarray, set[int], bytes]:
    """Number of words, masks of hit words and of those in windows of full length, items whose windows occur, and the text as normalised in place."""
    same = (text or b"").translate(NORMAL)
    joined = b" " + b" ".join(same.split()) + b" "
    n = joined.count(b" ") - 1 if len(joined) > 2 else 0
    hits: list[tuple[int, int]] = []
    items: set[int] = set()
    if n and found is not None:
        for end, (size, ids) in found.iter(joined.decode("latin-1")):
            hits.append((end, size))
            items.update(ids)
    mask = whole = np.zeros(n, bool)
    if hits:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        at, size = np.array(hits).T
        last = np.searchsorted(spaces, at)  # the separator after a window's last word has that word's number plus one
        mask, full = _covered(n, last - size, last), size == WINDOW
        whole = _covered(n, (last - size)[full], last[full])
    return n, mask, whole, items, same


def spans(mask: np.ndarray, same: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the original text that runs of hit words cover."""
    inside = np.frombuffer(same, np.uint8) != 32
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.r_[False, mask, False].astype(np.int8))
    return [(int(start[a]), int(end[b - 1])) for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1), strict=True)]


SCHEMA = "__row long, n_words long, hits array<struct<first:int,last:int,whole:boolean>>, items array<long>, spans array<struct<start:long,end:long>>"


def _scanned(docs: DataFrame, given) -> DataFrame:
    """__row, n_words, runs of hit words, items and byte spans for docs(__row, text); given: the windows, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_in_worker("decontamination", lambda: None)
        found = automaton(given.value)
        for b in in_turn(batches):
            out: tuple[list, ...] = ([], [], [], [])
            for text in b.column(1).cast(pa.large_binary()).to_pylist():
                n, mask, whole, got, same = scan(text, found)
                out[0].append(n)
                edge = np.diff(np.r_[False, mask, False].astype(np.int8)) if got else None
                out[1].append([{"first": int(x), "last": int(y) - 1, "whole": bool(whole[x:y].any())} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)] if got else [])
                out[2].append(sorted(got))
                out[3].append([{"start": x, "end": y} for x, y in spans(mask, same)] if got else [])
            types = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("whole", pa.bool_())])), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["__row", "n_words", "hits", "items", "spans"])

    return docs.mapInArrow(run, SCHEMA)


def segments(benchmark: DataFrame) -> DataFrame:
    """item_id, text of the benchmark's items; a long one in runs of words, which overlap so that each window is in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                w = words(text) if len(text) > SEGMENT_CHARS else None
                some = [text] if w is None else [b" ".join(w[i : i + SEGMENT_WORDS + WINDOW - 1]) for i in range(0, max(1, len(w) - WINDOW + 1), SEGMENT_WORDS)]
                ids.extend([item] * len(some))
                texts.extend(x.decode() for x in some)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["item_id", "text"])

    return benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "item_id long, text string")


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about PART_CHARS at most, each for one automaton."""
    given = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL")
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= PART_CHARS:
        return [given.select(F.col("item_id").cast("long"), "text")]
    cut = materialize(segments(benchmark), "benchmark-segments")
    n = 2 * -(-chars // PART_CHARS)
    return [cut.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _windows(part: DataFrame):
    """The part's windows for all tasks; what comes to the driver is what _parts bounds."""
    return part.sparkSession.sparkContext.broadcast(item_windows([(r[0], r[1].encode()) for r in part.collect()]))


def contaminated_words(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(__row, text) to __row, n_words, n_hit, items, spans; a row for each row of docs, whatever its __row."""
    parts = _parts(benchmark)
    if len(parts) == 1:
        length = lambda x: x["last"] - x["first"] + 1
        found = _scanned(docs, _windows(parts[0]))
        return found.select("__row", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + length(x)).alias("n_hit"), "items", "spans")
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("__row"), F.col("__row").alias("__given"), "text"), "scan-docs")
    found = _in_parts(keyed.select("__row", "text"), parts)
    return found.join(keyed.select("__row", "__given"), "__row").select(F.col("__given").alias("__row"), "n_words", "n_hit", "items", "spans")


def _in_parts(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Like contaminated_words, for docs with a __row of its own in each row, with hits of all parts united.

    One part after another is scanned, so that the driver and the tasks hold one part's windows at a time.
    """
    every = None
    for i, part in enumerate(parts):
        windows = _windows(part)
        found = _scanned(docs, windows)
        found = materialize(found if i == 0 else found.where(F.size("items") > 0), f"scan-{i}")
        every = found if every is None else every.unionByName(found)
        windows.unpersist()
    first = every.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("hits")).alias("h"), F.flatten(F.collect_list("spans")).alias("spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("h", lambda x: F.sequence(x["first"], x["last"])))))
    return first.select("__row", "n_words", covered.cast("long").alias("n_hit"), F.array_sort("items").alias("items"), F.array_sort("spans").alias("spans"))


def contaminated() -> F.Column:
    """The contract's verdict: windows cover a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages, with their columns.

    WINDOW words of an item in a row are a passage in a document of any length. An item of fewer words may stand in a text by chance,
    so such items count where they cover a twentieth of the words. With one part the scan runs beside the row and moves no text; with
    more, documents are written with a number each first.
    """
    parts = _parts(benchmark)
    if len(parts) == 1:
        return _kept(docs, _windows(parts[0]))
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")), "scan-docs")
    bad = None
    for i, part in enumerate(parts):
        windows = _windows(part)
        hit = materialize(_scanned(keyed.select("__row", F.col("__doc.text").alias("text")), windows).where(F.size("items") > 0).select("__row", "n_words", "hits"), f"scan-{i}")
        bad = hit if bad is None else bad.unionByName(hit)
        windows.unpersist()
    covered = bad.groupBy("__row").agg(F.max("n_words").alias("n"), F.flatten(F.collect_list("hits")).alias("h"))
    words_ = F.size(F.array_distinct(F.flatten(F.transform("h", lambda x: F.sequence(x["first"], x["last"])))))
    whole = bad.where(F.exists("hits", lambda x: x["whole"])).select("__row")
    gone = whole.unionByName(covered.where(20 * words_ >= F.col("n")).select("__row")).distinct()
    return keyed.join(gone, "__row", "left_anti").select(*(F.col("__doc")[c].alias(c) for c in docs.columns))


def _kept(docs: DataFrame, windows) -> DataFrame:
    def make():
        keep_in_worker("decontamination", lambda: None)
        found = automaton(windows.value)

        def clean(text: bytes | None) -> bool:
            n, mask, whole, *_ = scan(text, found)
            hit = int(mask.sum())
            return not (hit and (whole.any() or 20 * hit >= n))

        return lambda texts: [clean(t) for t in texts.cast(pa.large_binary()).to_pylist()]

    return rows_that_pass(docs, "text", make)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("__row"), "text")
    found = contaminated_words(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(F.col("__row").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH dw AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
iw AS (SELECT DISTINCT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
il AS (SELECT item_id, w, least(len(w), 13) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
lens AS (SELECT DISTINCT n FROM win),
dpos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM dpos) d JOIN win ON d.n = win.n AND d.s = win.s),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
