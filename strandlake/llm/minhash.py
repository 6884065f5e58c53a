"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct 5-word shingles (words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z). 128 minima are
taken; bands of five full minima give candidates, and of each minimum two bits are kept, packed as two planes of 128
bits. Matching bits, counted and corrected for chance agreement, estimate similarity; what may reach the threshold is
compared on full sets.

Groups of any size are handled without listing their pairs. Documents with equal sets fall together first. All band keys are
counted once; few of them occur twice, and only those rows go on. In a band's bucket every member is paired with the least one only;
verified pairs give components; then only buckets that still span several components are looked at. Their members get a second
signature of 1024 minima; members of different components are compared by their packed bits in blocks of bounded size, once for
all bands that they share, and those in any pair that may link come again with their whole sets, which are compared in the same
blocks, until what the block joins is joined. A block hands on members and no more links than it has members. So each pair that shares a band is either verified, or
estimated clearly below the threshold, or already connected.

Defined cases: null or wordless text has an empty set and links with nothing; with fewer than five words the whole
sequence is the one shingle; each row gets a row; rows that share a doc_id are one document, which links if any of them does, each
with its own number of shingles; rows without doc_id take no part; other columns pass through whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import in_turn, keep_in_worker, materialize, table
from strandlake.llm.components import connected_components
from strandlake.llm.line_dedup import LOWER

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
MINIMA, BANDS, ROWS, BITS = 128, 25, 5, 2
#: Minima of the second signature, which only documents get whose bucket the first verification leaves in several components.
WIDE = 1024
#: Standard deviations of the estimate by which a pair may fall short of the threshold and still be verified.
DEVIATIONS = 5.0
#: Members of a bucket that are compared with each other at once, and pairs that one verification group holds.
BLOCK = 256
#: Members of a bucket that are compared by their bits at once.
BITS_BLOCK = 512
#: Bytes of whole sets that one side of such a block holds, about.
BLOCK_BYTES = 32 << 20
#: Bits that tell which band keys occur again, for all tasks.
MOST_BITS = 1 << 29
#: Rows of ids that are broadcast to fetch their texts, 40 bytes each; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Parts that rows with one set are dealt into.
SALTS = 32

_rng = np.random.default_rng(20240229)
_FLIP, _TIMES = _rng.integers(0, 1 << 32, (MINIMA, 1), dtype=np.uint32), _rng.integers(0, 1 << 31, (MINIMA, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_wide_rng = np.random.default_rng(20240301)
_FLIP_WIDE, _TIMES_WIDE = _wide_rng.integers(0, 1 << 32, (WIDE, 1), dtype=np.uint32), _wide_rng.integers(0, 1 << 31, (WIDE, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = (text or b"").translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(WORDS, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s += (h[i : len(h) - n + 1 + i] ^ (h[i : len(h) - n + 1 + i] >> np.uint64(29))) * _PLACE[i]
    s = _mix(s)
    s.sort()
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits for the whole set."""
    return tuple(int(_mix(s ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0x1234567, 0x89ABCDEF))


def minima(s: np.ndarray, flip: np.ndarray = _FLIP, times: np.ndarray = _TIMES) -> np.ndarray:
    """Minima under different permutations, in blocks that fit the cache."""
    x, out = s.astype(np.uint32), np.full(len(flip), 0xFFFFFFFF, np.uint32)
    step = 1024 * MINIMA // len(flip)
    for i in range(0, len(x), step):
        out = np.minimum(out, ((x[i : i + step] ^ flip) * times).min(axis=1))
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The two low bits of each minimum, packed: the first bits of all, then the second bits."""
    return np.packbits(np.stack([m & np.uint32(1), (m >> np.uint32(1)) & np.uint32(1)]).astype(np.uint8), axis=1).view("<i8").ravel()


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((_mix(rows + _BAND[:, :ROWS]) * _BAND[:, :ROWS]).sum(axis=1, dtype=np.uint64) ^ _BAND[:, ROWS]).view(np.int64)


def most_mismatches(percent: int = PERCENT, deviations: float = DEVIATIONS, minima_: int = MINIMA) -> int:
    """Unequal packed values, of so many, that a pair at the threshold has at most, but for a chance of about one in a million."""
    chance = 1 / (1 << BITS)
    p = percent / 100 * (1 - chance) + chance  # corrected for collisions
    return int(minima_ * (1 - p) + deviations * (minima_ * p * (1 - p)) ** 0.5)


SIGNED = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("s1", "s2", "p0", "p1", "p2", "p3")), T.StructField("bands", T.ArrayType(T.LongType()))])
_P = ["p0", "p1", "p2", "p3"]


def signatures(docs: DataFrame) -> DataFrame:
    """docs(id, text) to set size, a 128-bit hash of the whole set, packed minima and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_in_worker("minhash", lambda: None)
        for b in in_turn(batches):
            rows, bands = [], []
            for text in b.column(1).cast(pa.large_binary()).to_pylist():
                s = shingles(text)
                if not len(s):
                    rows.append((0, 0, 0, 0, 0, 0, 0))
                    bands.append(None)
                    continue
                m = minima(s)
                rows.append((len(s), *set_hash(s), *packed(m).tolist()))
                bands.append(band_keys(m))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns), pa.array(bands, pa.list_(pa.int64()))], SIGNED.names)

    return docs.mapInArrow(run, SIGNED)


def _mismatches(a: str, b: str) -> F.Column:
    x = [F.col(f"{a}p{i}").bitwiseXOR(F.col(f"{b}p{i}")) for i in range(4)]
    return F.bit_count(x[0].bitwiseOR(x[2])) + F.bit_count(x[1].bitwiseOR(x[3]))


def _with_text(need: DataFrame, docs: DataFrame) -> DataFrame:
    """need(id, ...) with texts. A bounded list of ids goes to the documents, so that no other text is moved."""
    need = materialize(need, "need")
    if need.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(need), "id")
    return need.join(docs, "id")


def linked(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b, size) those that link on full sets. Each group has one centre's texts and at most some BLOCK others'.

    size is that of the largest bucket that holds the pair. A centre's partners are dealt over as many groups as that takes, and the
    centre is repeated once for each of its groups; texts go to the groups that need them.
    """
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / BLOCK)).cast("int").alias("salt")
    members = pairs.select(F.col("b").alias("id"), F.col("a").alias("centre"), salt)
    centres = members.select(F.col("centre").alias("id"), "centre", "salt").distinct()
    with_text = _with_text(members.unionByName(centres), docs).select("centre", "salt", (F.col("id") != F.col("centre")).cast("int").alias("part"), "id", "text")
    sorted_ = with_text.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for b in in_turn(batches):
            out_a, out_b = [], []
            for centre, salt, part, id_, text in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4).cast(pa.large_binary()).to_pylist(), strict=True):
                s = shingles(text)
                if (centre, salt) != now:
                    now, own = (centre, salt), []
                if not part:
                    own.append(s)  # rows that share a doc_id are all its sets
                    continue
                assert own, "a group comes without its centre"
                if any(similar(x, s, percent) for x in own):
                    out_a.append(centre)
                    out_b.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return sorted_.mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def wide_signatures(docs: DataFrame) -> DataFrame:
    """docs(id, text) to rep, s1, s2 and the packed bits of WIDE minima, for pairs that the short signature can't tell."""
    return _of_sets(docs, "wide", lambda s: packed(minima(s, _FLIP_WIDE, _TIMES_WIDE)).tobytes())


def whole_sets(docs: DataFrame) -> DataFrame:
    """docs(id, text) to rep, s1, s2 and the set's hashes."""
    return _of_sets(docs, "set", lambda s: s.tobytes())


def _of_sets(docs: DataFrame, name: str, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_turn(batches):
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingles(t) for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                hashes = [set_hash(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1)), pa.array(map(make, sets), pa.binary())], ["rep", "s1", "s2", name])

    return docs.mapInArrow(run, f"rep long, s1 long, s2 long, {name} binary").dropDuplicates(["rep", "s1", "s2"])


_LIGHT = ["key", "bi", "bj", "side", "comp", "rep", "s1", "s2", "n", *_P, "band"]


class _Blocks:
    """Rows of blocks in order, of which pairs of different components are looked at, each in its first common band only.

    doubted() has the rows that some pair allowed by its bits holds; links() the pairs that link on whole sets, as few as join what
    they join: not where components are joined already.
    """

    def __init__(self, t: np.ndarray, bands: np.ndarray, wide: np.ndarray, sets: list[bytes] | None, percent: int) -> None:
        self.t, self.bands, self.wide, self.sets, self.percent = t, bands, wide, sets, percent
        self.limit, self.wide_limit = most_mismatches(percent), most_mismatches(percent, minima_=WIDE)

    def _test(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        t = self.t
        ok = (t["comp"][i] != t["comp"][j]) & ((t["bi"][i] == t["bj"][i]) | (t["side"][i] != t["side"][j]))
        i, j = i[ok], j[ok]
        ok = 100 * np.minimum(t["n"][i], t["n"][j]) >= self.percent * np.maximum(t["n"][i], t["n"][j])
        i, j = i[ok], j[ok]
        x = [(t[p][i] ^ t[p][j]).view(np.uint64) for p in _P]
        ok = np.bitwise_count(x[0] | x[2]).astype(np.int64) + np.bitwise_count(x[1] | x[3]) <= self.limit
        i, j = i[ok], j[ok]
        for lo in range(0, len(i), 20_000):
            a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
            first = np.argmax(self.bands[a] == self.bands[b], axis=1) == t["band"][a]
            a, b = a[first], b[first]
            x = self.wide[a] ^ self.wide[b]
            half = x.shape[1] // 2
            near = np.bitwise_count(x[:, :half] | x[:, half:]).sum(axis=1, dtype=np.int64) <= self.wide_limit
            yield a[near], b[near]

    def _pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        t = self.t
        edge = np.flatnonzero(np.r_[True, (t["key"][1:] != t["key"][:-1]) | (t["bi"][1:] != t["bi"][:-1]) | (t["bj"][1:] != t["bj"][:-1])]) if len(t) else np.zeros(0, int)
        size = np.diff(np.r_[edge, len(t)])
        for n in np.unique(size[size > 1]).tolist():
            start = edge[size == n]
            for r0 in range(0, n - 1, slab := max(1, 200_000 // n)):  # some rows of a large group, all of small ones
                i, j = np.triu_indices(min(slab, n - r0), 1, n - r0)
                i, j = i + r0, j + r0
                for lo in range(0, len(start), step := max(1, 200_000 // len(i))):
                    base = start[lo : lo + step, None]
                    yield from self._test((base + i).ravel(), (base + j).ravel())

    def doubted(self) -> np.ndarray:
        found = np.zeros(len(self.t), bool)
        for i, j in self._pairs():
            found[i] = found[j] = True
        return np.flatnonzero(found)

    def links(self) -> tuple[list[int], list[int]]:
        top: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := top.get(c, c)) != c:
                top[c] = top.get(up, up)
                c = up
            return c

        out: tuple[list[int], list[int]] = ([], [])
        comp, rep = self.t["comp"], self.t["rep"]
        for i, j in self._pairs():
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                x, y = find(int(comp[a])), find(int(comp[b]))
                if x != y and similar(np.frombuffer(self.sets[a], np.uint64), np.frombuffer(self.sets[b], np.uint64), self.percent):
                    top[max(x, y)] = min(x, y)
                    out[0].append(int(rep[a]))
                    out[1].append(int(rep[b]))
        return out


def _in_blocks(rows: DataFrame, percent: int, schema: str, emit: Callable[[_Blocks], list[np.ndarray | list[int]]]) -> DataFrame:
    """What emit makes of rows(key, bi, bj, ..., bands, wide, perhaps set) in groups by (key, bi, bj), which are runs of a sorted partition."""
    names, held = [x.split()[0] for x in schema.split(", ")], "set" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([(c, np.int64) for c in _LIGHT])
        rest = [np.zeros(0, kind), np.zeros((0, BANDS), np.int64), np.zeros((0, WIDE // 32), np.uint64), []]

        def made(part: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in emit(_Blocks(*part[:3], part[3] if held else None, percent))], names)

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                b = whole_batch.slice(at, 512)
                t = np.zeros(b.num_rows, kind)
                for c in _LIGHT:
                    t[c] = b.column(c).to_numpy(zero_copy_only=False)
                bands = b.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
                wide = np.frombuffer(b"".join(b.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE // 32)
                whole = [*(np.concatenate(x) for x in zip(rest[:3], (t, bands, wide), strict=True)), rest[3] + (b.column("set").to_pylist() if held else [])]
                t = whole[0]
                same = (t["key"] == t["key"][-1]) & (t["bi"] == t["bi"][-1]) & (t["bj"] == t["bj"][-1])
                cut = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
                rest = [x[cut:] for x in whole]
                if cut:
                    yield made([x[:cut] for x in whole])
        yield made(rest)

    more = ["bands", "wide", *(["set"] if held else [])]
    keyed = rows.select(*(F.col(c).cast("long") for c in _LIGHT), *more).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return keyed.mapInArrow(run, schema)


_AT = ["key", "bi", "bj", "rep", "s1", "s2"]


def _doubted(x: _Blocks) -> list[np.ndarray]:
    rows = x.doubted()
    return [x.t[c][rows] for c in _AT]


def _maybe(own: DataFrame, buckets: DataFrame, n_keys: int) -> DataFrame:
    """own with a row for each band: those whose key may be one of the buckets', with few others.

    A bit for each hash of a bucket's key goes to all tasks, 64 MB of them at most; where that many would not sort out much, all
    rows go on, and the join does.
    """
    bits = 1 << max(20, math.ceil(math.log2(16 * max(1, n_keys))))
    if bits > MOST_BITS:
        bits = MOST_BITS
    columns = ["rep", "n", "s1", "s2", *_P]
    exploded = own.select(*columns, F.posexplode("bands").alias("band", "key"))
    if n_keys > bits // 2:
        return exploded
    place = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    maps = buckets.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    made = np.zeros(bits // 8, np.uint8)
    for r in maps.toLocalIterator():
        first = (r["at"] - 1) * 4096
        made[first : first + 4096] = np.frombuffer(r["bits"], np.uint8)[: bits // 8 - first]
    given = own.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = given.value
        for b in batches:
            keys = b.column("bands").flatten().to_numpy(zero_copy_only=False)
            at = keys & (bits - 1)
            hit = np.flatnonzero((there[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            rows = b.select(columns).take(pa.array(hit // BANDS))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array((hit % BANDS).astype(np.int32)), pa.array(keys[hit])], [*columns, "band", "key"])

    return own.select(*columns, "bands").mapInArrow(run, exploded.schema)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(id, text) to (id, n_shingles, component_id, rep): rep is the least document with the same set."""
    docs = docs.where("id IS NOT NULL")
    signed = materialize(signatures(docs), "signed")
    # only sets that occur again have to be looked up, over salts, as one of them may have a third of all rows
    reps = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("k")).where("k > 1").select("s1", "s2", "n", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    wide = signed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(reps, ["s1", "s2", "n", "salt"], "left").withColumn("rep", F.coalesce("rep", "id"))
    own_ = lambda c: F.when(F.col("id") == F.col("rep"), F.col(c)).alias(c)
    sets = materialize(wide.select("id", "n", "rep", *(own_(c) for c in ["s1", "s2", *_P, "bands"])), "sets")
    own = sets.where((F.col("id") == F.col("rep")) & (F.col("n") > 0)).dropDuplicates(["rep", "s1", "s2"]) if _repeated(sets).take(1) else sets.where((F.col("id") == F.col("rep")) & (F.col("n") > 0))
    # all bands once for their keys' counts; then only the rows whose key occurs again, with what is compared
    keys = own.select("rep", "n", F.explode("bands").alias("key"))
    buckets = materialize(keys.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("size"), F.sum("n").alias("sum")).where("size > 1"), "buckets")
    members = materialize(_maybe(own, buckets, buckets.count()).join(buckets, "key"), "members")
    centre = members.where("rep = a").select("key", *(F.col(c).alias("a" + c) for c in ["n", *_P]))
    near = (100 * F.least("an", "n") >= percent * F.greatest("an", "n")) & (_mismatches("a", "") <= most_mismatches(percent))
    stars = materialize(members.where("rep <> a").join(centre, "key").where(near).select("a", F.col("rep").alias("b"), "size"), "stars")
    pairs = stars.groupBy("a", "b").agg(F.max("size").alias("size"))
    first = materialize(linked(pairs, docs, percent).unionByName(_same_id(sets)), "linked")
    comps = materialize(connected_components(first), "components")

    placed = materialize(members.join(comps.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root", "a"), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    there = materialize(placed.join(mixed, "key"), "mixed")
    if there.take(1):
        row = ["rep", "s1", "s2"]
        wide = wide_signatures(_with_text(there.select(F.col("rep").alias("id")).distinct(), docs).select("id", "text"))
        held = materialize(wide.join(own.select(*row, "bands"), row), "signed-twice")
        blocks = F.ceil(F.greatest(F.col("size") / BITS_BLOCK, 8 * F.col("sum") / BLOCK_BYTES)).cast("int")
        sized = there.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep", "s1"), F.col("blocks")).cast("int"))
        spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = spread.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.col("own").alias("side"), "comp", *row, "n", *_P, "band").join(held, row)
        doubted = materialize(_in_blocks(dealt, percent, ", ".join(f"{c} long" for c in _AT), _doubted), "doubted")
        if doubted.take(1):
            texts = _with_text(doubted.select(F.col("rep").alias("id")).distinct(), docs).select("id", "text")
            asked = dealt.join(doubted, _AT, "left_semi").join(materialize(whole_sets(texts), "whole-sets"), row)
            more = materialize(_in_blocks(asked, percent, "a long, b long", _Blocks.links), "across")
            comps = materialize(connected_components(first.unionByName(more)), "components")
    return sets.select("id", F.col("n").alias("n_shingles"), "rep").join(comps.select(F.col("id").alias("rep"), "root"), "rep", "left").select("id", "n_shingles", F.coalesce("root", "rep").alias("component_id"), "rep")


def _repeated(sets: DataFrame) -> DataFrame:
    """Ids that rows with different sets share."""
    return sets.where("n > 0").groupBy("id").agg(F.count("*").alias("k"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("k > 1").select("id", "lo", "hi")


def _same_id(sets: DataFrame) -> DataFrame:
    """Links a, b of each id that rows with different sets share with the least documents that have these sets."""
    return sets.where("n > 0").join(_repeated(sets).where("lo < hi"), "id").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents but for those whose component holds a lesser doc_id; rows without doc_id stay."""
    found = near_duplicates(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), percent)
    gone = materialize(found.where(F.col("component_id") != F.col("id")).select(F.col("id").alias("doc_id")), "copies")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


#: Compares all sets that share a shingle.
ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), near AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a
), least_of AS (
    SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_id, d.doc_id) AS component_id, d.doc_id = coalesce(least_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_of ON least_of.doc_id = d.doc_id
"""


#: The contract of the query links at 0.85; the operator and the pipeline's stage take 0.8.
OP3_PERCENT = 85


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = near_duplicates(docs, OP3_PERCENT)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
