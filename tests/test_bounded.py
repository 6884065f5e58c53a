"""What a task holds and hands on: bounded by queries and slices, whatever number of rows it reads."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.operators import dense, lexical
from strandlake.operators.best import Best


def test_a_task_hands_on_the_best_of_all_its_batches(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((1500, 4)), 1)  # many ties
    rows = spark.createDataFrame([(i, i // 2, v) for i, v in enumerate(x.tolist())], "id long, ordinal long, v array<double>").coalesce(1)
    asked = np.round(rng.standard_normal((20, 4)), 1)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    given = spark.sparkContext.broadcast({(0, 4): (np.arange(20), unit(asked))})
    kept = rows.withColumn("key", F.lit(0).cast("long"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        handed = kept.mapInArrow(dense._best(given, 5), dense._hit_schema(kept)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    s = np.round(unit(asked) @ unit(np.where(np.abs(x).sum(axis=1, keepdims=True) > 0, x, 1e-9)).T, lexical.DIGITS)
    want = {(q, i) for q in range(20) for i in sorted(range(1500), key=lambda i: (-s[q, i], i // 2, i))[:5]}
    assert len(handed) == 100 and {(r["query_id"], r["id"]) for r in handed} == want


def test_texts_are_embedded_slice_by_slice():
    texts = pa.array([f"word{i} of a text" for i in range(1000)] + [None, ""])
    made = list(dense._hashed(64)(iter([texts, texts.slice(0, 3), texts.slice(0, 0)])))
    assert max(map(len, made)) <= dense.SLICE and sum(map(len, made)) == 1005
    v = np.concatenate([m.flatten().to_numpy().reshape(len(m), 64) for m in made])
    assert np.allclose(np.linalg.norm(v[:1000], axis=1), 1) and not v[1000:1002].any() and (v[1002:] == v[:3]).all()


@pytest.mark.parametrize("type_", [pa.int64(), pa.string()])
def test_best_keeps_the_order_of_ties(monkeypatch, type_):
    monkeypatch.setattr("strandlake.operators.best.WAITING", 50)
    rng = np.random.default_rng(4)
    q, score, ordinal, ident = rng.integers(0, 3, 4000), rng.integers(0, 9, 4000) / 8, rng.integers(0, 40, 4000), rng.permutation(4000)
    best = Best(3, 6)
    for lo in range(0, 4000, 37):
        s = slice(lo, lo + 37)
        best.add(q[s], pa.array(ident[s]).cast(type_), pa.array(ordinal[s]), score[s])
        assert best.rows <= 300
    got = {tuple(r.values()) for r in best.table().to_pylist()}
    of = str if type_ == pa.string() else int
    rows = [(int(a), of(b), int(c), float(d)) for a, b, c, d in zip(q, ident, ordinal, score, strict=True)]
    assert got == {r for k in range(3) for r in sorted((x for x in rows if x[0] == k), key=lambda x: (-x[3], x[2], x[1]))[:6]}


@pytest.mark.parametrize("at_once", [1 << 19, 7])
def test_runs_are_hashed_over_all_texts_at_once(monkeypatch, at_once):
    monkeypatch.setattr(dense, "AT_ONCE", at_once)
    texts = ["Abc abc", "", None, "a", "a b1 c#d", "été İx K9", "word " * 40, "x" * 60, " lead", "\ud800q1 tail"]
    want = np.zeros((len(texts), 64), int)
    for i, t in enumerate(texts):
        for token in re.findall("[a-z0-9]+", (t or "").lower()):
            m = f"#{token}#".encode()
            for h in (zlib.crc32(m[k : k + n]) for n in (3, 4, 5) for k in range(len(m) - n + 1)):
                want[i, h % 64] += 1 if h >> 16 & 1 else -1
    assert (dense.hashed_counts(texts, 64) == want).all() and not hasattr(dense, "token_buckets")
    assert dense.hashed_counts([], 64).shape == (0, 64)
