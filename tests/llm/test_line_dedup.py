import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(docs):
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if gone.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(left), "\n".join(left))
    return out


def test_against_brute_force(spark, make):
    w = make(1)
    common = [w(6) for _ in range(5)] + ["ÄÖÜ" * 7, "x" * 19, "y" * 20, "é" * 19]
    docs = [(i, "\n".join(common[(i * j) % len(common)] if j % 2 else w(8) for j in range(i % 7 + 1))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "  " + common[0].upper() + "\t\n" + common[0] + "\n\n"), (103, common[0] + " ")]
    want = brute(docs)
    rows = spark.createDataFrame([(i, t, i * 2, "z") for i, t in docs], "doc_id long, text string, n long, h1 string").repartition(3)
    kept = L.dedup_lines(rows)
    assert kept.columns == rows.columns
    got = {r["doc_id"]: r for r in kept.collect()}
    assert {i: r["text"] or "" for i, r in got.items()} == {i: v[2] for i, v in want.items()} and got[5]["n"] == 10 and got[100]["text"] is None
    digest = L._rewrite(rows, L.lines_to_drop(L.line_table(rows)), digest=True)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in digest.collect()} == {i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for i, (a, b, c) in want.items()}


def test_filters_that_meet_their_lines(spark, make, monkeypatch):
    """Filters too large for all tasks: the same lines go, over several shards and salts."""
    w = make(3)
    lines = [w(9) for _ in range(300)]
    docs = [(i, "\n".join(lines[(i * j * j) % 300] for j in range(8)) + "\n" + lines[0]) for i in range(200)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    table = L.materialize(L.line_table(rows), "lines")
    want = sorted(map(tuple, L.lines_to_drop(table).select("doc_id", F.explode("gone").alias("g")).select("doc_id", "g.*").collect()))
    for name, value in (("FILTER_BYTES", 0), ("KEYS_PER_SHARD", 20), ("LOOKUPS", 50)):
        monkeypatch.setattr(L, name, value)
    got = L.lines_to_drop(table).select("doc_id", F.explode("gone").alias("g")).select("doc_id", "g.*").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 300
    refs = L.materialize(L.reference_counts(table).where("n >= 3"), "refs")
    shards, n = L.filter_shards(refs, refs.count())
    hits = L.probable(table, shards, n, refs.count())
    assert n > 4 and hits.join(refs, ["h1", "h2"], "left_semi").count() == table.join(refs, ["h1", "h2"], "left_semi").count() <= hits.count() < table.count()


def test_without_filters_and_empty(spark, make, monkeypatch):
    monkeypatch.setattr(L, "FILTER_BYTES", 0)
    rows = spark.createDataFrame([(i, "the same line that is long enough") for i in range(4)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in L.dedup_lines(rows).collect()) == [(0, ""), (1, ""), (2, ""), (3, "the same line that is long enough")]
    assert L.dedup_lines(rows.limit(0)).count() == 0


def test_insert_and_delete_are_reversible(spark, make):
    w = make(2)
    lines = [w(7) for _ in range(6)]
    docs = spark.createDataFrame([(i, "\n".join(lines[: i % 6 + 1])) for i in range(20)], "doc_id long, text string")
    index = L.LineIndex(spark)
    index.insert(docs.where("doc_id < 12"))
    before = sorted(map(tuple, index.drops().collect()))
    index.insert(docs.where("doc_id >= 12"))
    assert sorted(map(tuple, index.drops().collect())) != before
    index.delete(docs.where("doc_id >= 12"))
    assert sorted(map(tuple, index.drops().collect())) == before
    gone = L.lines_to_drop(L.line_table(docs.where("doc_id < 12"))).select("doc_id", F.explode("gone").alias("g")).select("doc_id", "g.h1", "g.h2")
    assert sorted(map(tuple, gone.collect())) == before


def test_inserts_that_grow_the_repeated_keys_tenfold(spark, monkeypatch):
    monkeypatch.setattr(L, "KEYS_PER_SHARD", 600)  # several shards from the third insert on
    lines = [f"line {k:05d} that is long enough" for k in range(2200)]

    def batch(first, last, ids):
        return spark.createDataFrame([(i, "\n".join(lines[first:last])) for i in ids], "doc_id long, text string")

    def keys(rows):
        return sorted(map(tuple, rows.collect()))

    index, docs = L.LineIndex(spark), None
    for first, last, ids in [(0, 100, range(3)), (100, 1000, range(3, 6)), (1000, 2000, range(6, 9)), (2000, 2200, range(9, 12))]:
        more = batch(first, last, ids)
        docs = more if docs is None else docs.unionByName(more)
        index.insert(more)
        gone = L.lines_to_drop(L.line_table(docs)).select("doc_id", F.explode("gone").alias("g")).select("doc_id", "g.h1", "g.h2")
        assert keys(index.drops()) == keys(gone) and index.drops().count() == 2 * last
        if last == 1000:
            before = keys(index.drops())
    shards = index.shards.collect()
    assert len(shards) == index.n_shards > 1 and all((np.frombuffer(r["cells"], np.uint16) > 0).mean() <= L.MOST_LOAD for r in shards)
    index.delete(docs.where("doc_id >= 6"))
    assert keys(index.drops()) == before


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 9))
def test_cuckoo_filter_has_no_false_negatives(n, seed):
    rng = np.random.default_rng(seed)
    h1, h2 = (rng.integers(-(1 << 62), 1 << 62, n) for _ in range(2))
    f = L.CuckooFilter.of(h1, h2)
    assert f.contains(h1, h2).all() and L.CuckooFilter.load(f.dump()).contains(h1, h2).all()
    f.delete(h1[: n // 2], h2[: n // 2])
    assert f.contains(h1[n // 2 :], h2[n // 2 :]).all()
    other = rng.integers(-(1 << 62), 1 << 62, 2000)
    assert f.contains(other, other).mean() < 0.01
