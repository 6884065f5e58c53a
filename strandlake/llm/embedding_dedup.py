"""Embedding near-dedup: all pairs of a label, compared in blocks.

Every vector of a label is compared with every other one of it. A label's vectors are dealt into blocks by a hash of their ids, and a
task holds the two blocks of a pair. Tiles of them are multiplied in single precision; what reaches the threshold less all that this
can lose is multiplied again in double precision, which alone decides. Links are handed on as far as they join what was apart. The
time grows with the square of a label and rows move once for each of its blocks (README).

A caller who asks for a recall below 1 gets sorted projection passes for large labels instead: each pass hashes every vector by BITS
random hyperplanes through the label's centre, sorts a label by the bits and compares each vector with its WINDOW next neighbours. The
centre, the mean of a sample, and the number of passes are told by a sample of the label, so that links of a crowd that the sample
misses may be lost. Vectors at the threshold agree on one bit with probability p = 1 - angle / pi, the angle seen from the centre,
and have to agree on so many bits that no more than WINDOW others are expected to agree on them too, so that a pass finds them with p
to that power. Members that link are not counted among those others: they are of one component. Where comparing all pairs costs
less, that is done. All passes are one range-partitioned sort; the heads and tails of neighbouring partitions are compared
afterwards, so that windows don't end at partitions. The query asks for no such thing.

Inside each component links are then counted exactly. Members within half the threshold's angle of the component's mean direction
are all linked with each other, so they are counted by their number; only the members further out are compared with the whole
component, in blocks. Equal vectors are one class with its size, whatever their number.

Components are found by star steps on the link table. No vectors go to the driver.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows without a label link with
nothing; vectors of different lengths never link; rows that share a vec_id are one class member each and link when they are
alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import materialize, table
from strandlake.llm.components import connected_components

THRESHOLD = 0.93
WINDOW, BITS = 64, 48
#: Chance that a pair exactly at the threshold meets in some pass, where passes are asked for.
RECALL = 0.999
#: Vectors of a label from which its centre and passes are told, about.
SAMPLE = 256
#: Vectors that one side of a block of all pairs holds, about, and parts that a label's rows are dealt into to learn its passes.
PAIRS_BLOCK, SALTS = 1024, 32
#: Where all pairs are compared: blocks of a label, fewer where they would hold less than PAIRS_BLOCK vectors and more where they would
#: hold more than these bytes in double precision, about; rows of a tile, multiplied at once.
PARTS, BLOCK_BYTES, TILE = 8, 32 << 20, 512
#: Members that one block of an exact comparison holds.
BLOCK = 512
#: Room for rounding where angles decide, in radians.
MARGIN = 1e-6


def passes_for(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    agree = 1 - math.acos(threshold) / math.pi
    found = agree ** max(1.0, math.log2(max(2, largest) / window))
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def passes_of(x: np.ndarray, n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes for a label of n vectors with the unit vectors x among them, or 0 where comparing all pairs costs less."""
    z = x - x.mean(axis=0)
    far2 = (z * z).sum(axis=1)
    z /= np.sqrt(np.maximum(far2, 1e-300))[:, None]
    step = (1 - np.arccos(np.clip(z @ z.T, -1, 1)) / math.pi) ** 0.25
    others = (x @ x.T < threshold) * (n / max(1, len(x) - 1))
    bits, crowd = np.zeros(len(x)), others.sum(axis=1)
    for i in range(1, 4 * BITS + 1):  # in quarters of a bit, one at least
        others *= step
        more = (crowd > window) | (i <= 4)
        bits[more], crowd[more] = i / 4, others.sum(axis=1)[more]
    agree = 1 - np.arccos(np.clip(1 - (1 - threshold) / np.maximum(far2, 1e-300), -1, 1)) / math.pi
    missed = 1 - agree**bits * np.minimum(1, window / np.maximum(crowd, 1e-300))
    low, high = passes_for(n, threshold, window, recall), -(-n // window)
    if low >= high or (missed**high).mean() > 1 - recall:
        return 0
    while low < high:
        k = (low + high) // 2
        low, high = (low, k) if (missed**k).mean() <= 1 - recall else (k + 1, high)
    return low if low * window < n else 0


def planes(pass_: int, dim: int) -> np.ndarray:
    return np.random.default_rng([20240117, pass_, dim]).standard_normal((dim, BITS))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _unit(column: pa.Array) -> np.ndarray:
    x = _matrix(column)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vectors(vec_id, embedding, label) to members(vec_id, cls) and classes(cls, grp, v, size): usable ones by equal vectors, as they are."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("embedding", lambda x: x != 0)
    usable = vectors.where(F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull())
    keyed = usable.select("vec_id", F.xxhash64("label", F.size("embedding")).alias("grp"), F.col("label").cast("string").alias("lab"), F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)).alias("v"))
    keyed = keyed.select("*", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))  # no negative zeros
    classes = materialize(keyed.groupBy("grp", "lab", "h1", "h2").agg(F.min("vec_id").alias("cls"), F.count("*").alias("size"), F.first("v").alias("v")), "classes")
    members = keyed.select("vec_id", "grp", "lab", "h1", "h2").join(classes.select("grp", "lab", "h1", "h2", "cls"), ["grp", "lab", "h1", "h2"]).select("vec_id", "cls")
    return members, classes.select("cls", "grp", "v", "size")


def joining(ids: np.ndarray, found: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of linked places (i, i + d), given for d = 1, 2, ..., as few links as join the same ids."""
    first = next(found)
    joined = np.zeros(len(ids), bool)
    joined[first + 1] = True
    run = np.cumsum(~joined) - 1
    top = np.arange(run[-1] + 1 if len(run) else 0)
    a, b = [first], [first + 1]
    for d, i in enumerate(found, 2):
        i = i[top[run[i]] != top[run[i + d]]]
        if not len(i):
            continue
        kept = []
        for k in i.tolist():  # each joins two runs that were apart, or is dropped
            x, y = top[run[k]], top[run[k + d]]
            while top[x] != x:
                x = top[x]
            while top[y] != y:
                y = top[y]
            if x != y:
                top[max(x, y)] = min(x, y)
                kept.append(k)
        while (top != top[top]).any():
            top = top[top]
        a.append(np.array(kept, np.int64))
        b.append(np.array(kept, np.int64) + d)
    return ids[np.concatenate(a)], ids[np.concatenate(b)]


class _Window:
    """Compares rows that come in order with the rows up to a window before them; only rows with equal keys link."""

    def __init__(self, threshold: float, window: int) -> None:
        self.threshold, self.window = threshold, window
        self.keys, self.ids, self.x = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), None

    def feed(self, keys: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        old = len(self.ids) if self.x is not None and self.x.shape[1] == x.shape[1] else 0
        if old:
            keys, ids, x = np.concatenate([self.keys, keys]), np.concatenate([self.ids, ids]), np.concatenate([self.x, x])

        def near() -> Iterator[np.ndarray]:
            for d in range(1, self.window + 1):
                i = np.arange(max(0, old - d), max(0, len(ids) - d))
                i = i[(keys[i] == keys[i + d]).all(axis=1)]
                parts = [i[lo : lo + 16_384] for lo in range(0, len(i), 16_384)]
                yield np.concatenate([np.zeros(0, np.int64), *(p[np.einsum("ij,ij->i", x[p], x[p + d]) >= self.threshold] for p in parts)])

        out = joining(ids, near())
        self.keys, self.ids, self.x = keys[-self.window :], ids[-self.window :], x[-self.window :]
        return out


def _rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pass, grp), ids and unit vectors of a batch, in runs of equal length."""
    lengths = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for part in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(lengths)) + 1):
        if len(part):
            s = b.slice(int(part[0]), len(part))
            keys = np.stack([s.column("pass").to_numpy(zero_copy_only=False).astype(np.int64), s.column("grp").to_numpy(zero_copy_only=False)], axis=1)
            yield keys, s.column("cls").to_numpy(zero_copy_only=False), _unit(s.column("v"))


def whole_groups(classes: DataFrame) -> DataFrame:
    """grp and blocks of the groups that take more than one; all of their pairs are compared."""
    sizes = classes.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("v")).cast("long").alias("dim"))
    blocks = F.greatest(F.least(F.lit(PARTS), F.ceil(F.col("n") / PAIRS_BLOCK)), F.ceil(F.col("n") * F.col("dim") * 8 / BLOCK_BYTES))
    return materialize(sizes.select("grp", blocks.cast("int").alias("blocks"), F.lit(0).alias("passes")).where("blocks > 1"), "groups")


def large_groups(classes: DataFrame, threshold: float, window: int, recall: float) -> DataFrame:
    """grp, blocks, passes and centre of the groups of more than a few windows; no passes where all pairs are compared.

    Only for a caller who asks for a recall below 1, as a sample tells passes and centre.
    """
    sizes = classes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > 4 * window)
    sizes = materialize(sizes.withColumn("every", F.ceil(F.col("n") / SAMPLE).cast("long")), "group-sizes")
    sample = classes.join(F.broadcast(sizes), "grp").where(F.pmod(F.xxhash64("cls", F.lit(20240117)), F.col("every")) == 0)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pa.array(pdf["v"]))
        return pd.DataFrame({"grp": [int(pdf["grp"].iloc[0])], "passes": [passes_of(x, int(pdf["n"].iloc[0]), threshold, window, recall)], "centre": [x.mean(axis=0)]})

    measured = sample.select("grp", "n", "v").groupBy("grp").applyInPandas(measure, "grp long, passes int, centre array<double>")
    blocks = F.ceil(F.col("n") / PAIRS_BLOCK).cast("int").alias("blocks")
    return materialize(sizes.join(measured, "grp", "left").select("grp", blocks, F.coalesce("passes", F.lit(0)).alias("passes"), "centre"), "groups")


def _in_groups(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """classes with what is known of their group, over salts, as one group may have most of the rows."""
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return classes.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(salted, ["grp", "salt"], "left")


def spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links in a symmetric matrix as few as join the same places."""
    left, a, b = np.ones(len(hit), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in np.flatnonzero(hit.any(axis=1)).tolist():
        at = [first] if left[first] else []
        left[first] = False
        while at:
            i = at.pop()
            new = np.flatnonzero(hit[i] & left)
            left[new] = False
            a.append(np.full(len(new), i))
            b.append(new)
            at.extend(new.tolist())
    return np.concatenate(a), np.concatenate(b)


def least_links(x: np.ndarray, m: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between unit vectors x[:m] and x[m:], or within x where m is all of them, as few as join the same places.

    Single precision loses less than slack, so that what it leaves out is no link; double precision decides the rest.
    """
    single, slack = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-23
    top, a, b = np.arange(len(x)), [], []
    for lo in range(0, m, TILE):
        i = np.arange(lo, min(lo + TILE, m))
        for at in range(lo if m == len(x) else m, len(x), TILE):
            j = np.arange(at, min(at + TILE, len(x)))
            cosine = single[lo : lo + len(i)] @ single[at : at + len(j)].T
            if cosine.max() < threshold - slack:
                continue
            near = (cosine >= threshold - slack) & (top[i][:, None] != top[j])  # those of one component need no link
            r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(r):
                continue
            both = np.zeros((len(r) + len(c),) * 2, bool)
            both[: len(r), len(r) :] = near[np.ix_(r, c)] & (x[i[r]] @ x[j[c]].T >= threshold)
            both[len(r) :, : len(r)] = both[: len(r), len(r) :].T
            place = np.concatenate([i[r], j[c]])
            for p, q in zip(*(place[k].tolist() for k in spanning(both)), strict=True):
                u, v = top[p], top[q]
                while top[u] != u:
                    u = top[u]
                while top[v] != v:
                    v = top[v]
                if u != v:
                    top[max(u, v)] = min(u, v)
                    a.append(p)
                    b.append(q)
            while (top != top[top]).any():
                top = top[top]
    return np.array(a, np.int64), np.array(b, np.int64)


def all_pairs_links(classes: DataFrame, groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links a, b of the groups without passes; not all of them, but as many as join them in each block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []

        def emit() -> Iterator[pa.RecordBatch]:
            side, ids, x = (np.concatenate(c) for c in zip(*kept, strict=True))
            kept.clear()
            if now[1] != now[2]:
                order = np.argsort(side, kind="stable")
                side, ids, x = side[order], ids[order], x[order]
            a, b = least_links(x, int((side == now[1]).sum()), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], ["a", "b"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("grp", "bi", "bj")] + [b.column("v").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            for part in np.split(np.arange(len(keys)), np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1):
                if len(part):
                    s, key = b.slice(int(part[0]), len(part)), tuple(keys[part[0]].tolist())
                    if key != now:
                        if kept:
                            yield from emit()
                        now, kept = key, []
                    kept.append((s.column("side").to_numpy(zero_copy_only=False), s.column("cls").to_numpy(zero_copy_only=False), _unit(s.column("v"))))
        if kept:
            yield from emit()

    of = _in_groups(classes, groups.drop("centre")).where("coalesce(passes, 0) = 0").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = of.withColumn("side", F.pmod(F.xxhash64("cls", F.lit(20240118)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("grp", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "cls", "v")
    return rows.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", F.size("v")).mapInArrow(run, "a long, b long")


def _keyed(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each class and pass of its group: its bits as one number, and the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(BITS)[::-1]).astype(np.int64)
        made: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            lengths = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                s = b.filter(pa.array(lengths == dim))
                passes = s.column("passes").to_numpy(zero_copy_only=False)
                x = _unit(s.column("v")) - _matrix(s.column("centre"))
                for k in range(passes.max()):
                    if (k, dim) not in made:
                        made[k, dim] = planes(k, int(dim))
                    if (passes <= k).any():
                        more = passes > k
                        s, x, passes = s.filter(pa.array(more)), x[more], passes[more]
                    bits = ((x @ made[k, dim]) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([s.column("cls"), s.column("grp"), s.column("v"), pa.array(np.full(len(x), k, np.int32)), pa.array(bits)], ["cls", "grp", "v", "pass", "bits"])

    kind = classes.schema["v"].dataType.simpleString()
    return _in_groups(classes, groups.where("passes > 0")).where("passes > 0").select("cls", "grp", "v", "passes", "centre").mapInArrow(run, f"cls long, grp long, v {kind}, pass int, bits long")


def candidate_links(classes: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """Verified links a, b between classes that meet in a window of some pass; not all of them, but as many as join them.

    The tasks that sort compare at once, so that vectors move once for each pass. Each hands on its first and last rows, and
    those of neighbouring partitions are compared in a second, small step.
    """
    order, kind = ["pass", "grp", "bits", "cls"], classes.schema["v"].dataType.simpleString()
    ranged = _keyed(classes, groups).repartitionByRange(*order).sortWithinPartitions(*order)
    edge = ["seam", "at", "cls", "grp", "v", "pass"]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, part, done, last = _Window(threshold, window), TaskContext.get().partitionId(), 0, None

        def rows(s: pa.RecordBatch, seam: int, at: int) -> pa.RecordBatch:
            n = s.num_rows
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array([seam] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), s.column("cls"), s.column("grp"), s.column("v"), s.column("pass")], ["a", "b", *edge])

        for b in batches:
            for keys, ids, x in _rows(b):
                a, c = w.feed(keys, ids, x)
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), *(pa.nulls(n, b.schema.field(k).type if k in b.schema.names else pa.int64()) for k in edge)], ["a", "b", *edge])
            if done < window:
                yield rows(b.slice(0, window - done), part - 1, 1 << 40 | done)
            done += b.num_rows
            last = b if last is None or b.num_rows >= window else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            last = last.slice(max(0, last.num_rows - window))
        if last is not None and last.num_rows:
            yield rows(last, part, 0)

    found = materialize(ranged.mapInArrow(inside, f"a long, b long, seam long, at long, cls long, grp long, v {kind}, pass int"), "window-links")

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, now = None, None
        for b in batches:
            seam = b.column("seam").to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(seam)), np.flatnonzero(np.diff(seam)) + 1):
                if len(part):
                    if seam[part[0]] != now:
                        w, now = _Window(threshold, window), seam[part[0]]
                    for rows in _rows(b.slice(int(part[0]), len(part))):
                        a, c = w.feed(*rows)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    across = found.where("seam IS NOT NULL").select(*edge).repartition("seam").sortWithinPartitions("seam", "at").mapInArrow(seams, "a long, b long")
    return found.where("a IS NOT NULL").select("a", "b").unionByName(across).distinct()


def _blocked(inner: DataFrame, threshold: float) -> DataFrame:
    """rows(comp, bi, bj, side, cls, size, v): links of side-0 rows with side-1 rows of the same block pair, counted for both.

    Sides are "o" (outer) and "m" (any member). An outer's count comes from all its pairs, a safe member's from outers alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, outer = None, [], []

        def emit() -> Iterator[pa.RecordBatch]:
            if not x or not outer:
                return
            a, b = np.array([r[2] for r in outer]), np.array([r[2] for r in x])
            hit = (a @ b.T) >= threshold
            ia, ib = np.array([r[0] for r in outer]), np.array([r[0] for r in x])
            hit &= ia[:, None] != ib[None, :]
            na, nb = np.array([r[1] for r in outer]), np.array([r[1] for r in x])
            safe = np.array([r[3] for r in x], bool)
            count = np.concatenate([hit @ nb, (na @ hit)[safe]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ia, ib[safe]])), pa.array(count.astype(np.int64))], ["cls", "n"])

        for b in batches:
            v = _matrix(b.column("v")) if len(np.unique(b.column("v").value_lengths())) == 1 else [np.array(r, float) for r in b.column("v").to_pylist()]
            for i, (comp, bi, bj, side, cls, size, safe) in enumerate(zip(*(b.column(c).to_pylist() for c in ("comp", "bi", "bj", "side", "cls", "size", "safe")), strict=True)):
                if now != (comp, bi, bj):
                    yield from emit()
                    now, x, outer = (comp, bi, bj), [], []
                (outer if side == "o" else x).append((cls, size, v[i], safe))
        yield from emit()

    dealt = inner.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    return dealt.select("comp", "bi", "bj", "side", "cls", "size", "safe", "v").mapInArrow(run, "cls long, n long")


def _normalised(rows: DataFrame) -> DataFrame:
    """rows(comp, cls, size, v) with v of unit length, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(lengths)) + 1):
                if len(part):
                    s = b.slice(int(part[0]), len(part))
                    x = _unit(s.column("v"))
                    v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*s.columns[:3], v], ["comp", "cls", "size", "v"])

    return rows.mapInArrow(run, "comp long, cls long, size long, v array<double>")


def _safe(rows: DataFrame, half: float) -> DataFrame:
    """rows(comp, cls, size, v, salt, salts, c) with safe instead of c: whether v is within the angle of c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(lengths)) + 1):
                if len(part):
                    s = b.slice(int(part[0]), len(part))
                    x, c = _matrix(s.column("v")), _matrix(s.column("c"))
                    near = np.einsum("ij,ij->i", x, c) >= half * np.linalg.norm(c, axis=1)
                    yield pa.RecordBatch.from_arrays([*s.columns[:6], pa.array(near & (np.abs(c).max(axis=1) > 0))], ["comp", "cls", "size", "v", "salt", "salts", "safe"])

    return rows.mapInArrow(run, "comp long, cls long, size long, v array<double>, salt int, salts int, safe boolean")


def exact_links(classes: DataFrame, comps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """classes(cls, v, size) and comps(cls, comp) to cls, n: how many other rows each class's rows link with inside the component, copies not counted."""
    inside = materialize(_normalised(classes.join(comps, "cls").select("comp", "cls", "size", "v")), "in-components")
    counted = inside.groupBy("comp").agg(F.count("*").alias("k"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            comp, where = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x, total = _matrix(b.column(1).filter(pa.array(lengths == dim))), np.zeros((len(comp), dim))
                np.add.at(total, where[at], x)
                for c, row in zip(comp[np.unique(where[at])].tolist(), total[np.unique(where[at])], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([c] * dim), pa.array(range(dim), pa.int32()), pa.array(row)], ["comp", "i", "s"])

    parts = inside.select("comp", "v").mapInArrow(sums, "comp long, i int, s double")
    means = parts.groupBy("comp", "i").agg(F.sum("s").alias("s")).groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("m"))  # as many as a vector has
    centres = materialize(means.select("comp", F.transform("m", lambda x: x["s"]).alias("c")).join(counted, "comp").withColumn("salts", F.ceil(F.col("k") / BLOCK).cast("int")), "centres")
    salted = centres.select("comp", "c", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    keyed = inside.join(_by_size(centres, "salts"), "comp").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")).drop("salts")
    half = math.cos(math.acos(threshold) / 2 - MARGIN)
    judged = materialize(_safe(keyed.join(salted, ["comp", "salt"]).select("comp", "cls", "size", "v", "salt", "salts", "c"), half), "judged")
    safe = judged.where("safe").groupBy("comp").agg(F.sum("size").alias("n_safe"))
    outer = judged.where("NOT safe")
    blocks = outer.select("comp", "salt").distinct()
    o = outer.select("comp", F.col("salt").alias("bi"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("bj"), F.lit("o").alias("side"), "cls", "size", "safe", "v")
    m = judged.join(blocks.withColumnRenamed("salt", "bi"), "comp").select("comp", "bi", F.col("salt").alias("bj"), F.lit("m").alias("side"), "cls", "size", "safe", "v")
    far = _blocked(o.unionByName(m), threshold).groupBy("cls").agg(F.sum("n").alias("n"))
    near = judged.where("safe").select("comp", "cls", "size").join(safe, "comp").select("cls", (F.col("n_safe") - F.col("size")).alias("n"))
    return near.unionByName(far).groupBy("cls").agg(F.sum("n").alias("n"))


def _by_size(centres: DataFrame, column: str) -> DataFrame:
    """A narrow table of components, small beside the vectors."""
    return centres.select("comp", column)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = 1.0) -> DataFrame:
    """vectors(vec_id, embedding, label) to vec_id, n_links, component_id, of all pairs.

    A recall below 1 allows passes with this window in large labels, which may lose links.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    members, classes = classes_of(vectors)
    members = materialize(members, "class-members")
    groups = whole_groups(classes) if recall >= 1 else large_groups(classes, threshold, window, recall)
    links = all_pairs_links(classes, groups, threshold)
    if recall < 1:
        links = links.unionByName(candidate_links(classes, groups, threshold, window))
    links = materialize(links, "vector-links")
    comps = materialize(connected_components(links).select(F.col("id").alias("cls"), F.col("root").alias("comp")).distinct(), "vector-components")
    exact = exact_links(classes, comps, threshold)
    known = classes.select("cls", "size").join(comps, "cls", "left").join(exact, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("component_id"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    found = members.join(materialize(known, "class-links"), "cls").select("vec_id", "n_links", "component_id")
    return vectors.select("vec_id").join(found.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


#: Compares all vectors of a label.
ORACLE = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), sized AS (
    SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM usable WHERE list_dot_product(v, v) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM sized a JOIN sized b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
), near AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a
), known AS (
    SELECT a AS vec_id, min(b) AS least_id FROM reach GROUP BY a
), counted AS (
    SELECT a AS vec_id, count(*) AS n FROM near GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(least_id, e.vec_id) AS component_id, e.vec_id = coalesce(least_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN known ON known.vec_id = e.vec_id LEFT JOIN counted ON counted.vec_id = e.vec_id
"""


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
