"""What must hold at any size: order of a large corpus, fingerprints, neighbours of many queries, the approximate index, labelled quality."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import staging
from strandlake.operators import chunking, dense, evaluate, lexical
from strandlake.schemas import METADATA


def chunk_rows(spark, n):
    """n documents of two blocks of two parts each, and three policies."""
    docs = spark.range(n).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("source"))
    each = docs.select("source", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("source", F.lit(1).alias("art_ord"), F.floor(F.col("k") / 2).cast("int").alias("block"), (F.col("k") % 2).alias("part"))
    empty = [F.lit("").alias(c) for c in METADATA if c not in ("source", "kind")]
    named = each.withColumn("chunk_id", F.concat("source", F.lit("::"), F.col("block").cast("string"), F.lit("."), F.col("part").cast("string")))
    regs = named.select("*", F.lit("t").alias("text"), F.lit("b").alias("body"), F.lit("regulation").alias("kind"), *empty)
    pols = spark.range(3).select(F.concat(F.lit("policy::"), F.col("id").cast("string")).alias("chunk_id"), F.lit("p").alias("text"), F.lit("b").alias("body"), F.lit("policy").alias("kind"), F.lit("policy_register").alias("source"), *empty)
    return regs, pols


def test_ordinals_of_many_documents(spark):
    """More documents than packed bits had room for: ordinals are the places in the whole order, without gaps or ties."""
    n = 550_000
    regs, pols = chunk_rows(spark, n)
    made = chunking.corpus(regs, pols).select("ordinal", "chunk_id").cache()
    r = made.agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal"), F.count("*")).first()
    assert tuple(r) == (0, 4 * n + 2, 4 * n + 3, 4 * n + 3)
    ends = {x["ordinal"]: x["chunk_id"] for x in made.where(f"ordinal < 6 OR ordinal >= {4 * n - 1}").collect()}
    assert [ends[i] for i in range(6)] == ["d0000000::0.0", "d0000000::0.1", "d0000000::1.0", "d0000000::1.1", "d0000001::0.0", "d0000001::0.1"]
    assert [ends[4 * n + i] for i in range(-1, 3)] == [f"d{n - 1:07d}::1.1", "policy::0", "policy::1", "policy::2"]
    place = F.substring("chunk_id", 2, 7).cast("long") * 4 + F.substring("chunk_id", 11, 1).cast("long") * 2 + F.substring("chunk_id", 13, 1).cast("long")
    assert made.where(F.col("chunk_id").startswith("d") & (F.col("ordinal") != place)).count() == 0
    made.unpersist()


def test_trees_tell_changes(spark):
    rows = spark.createDataFrame([(i, f"c{i}", f"text {i}", *[str(i % 3)] * len(METADATA)) for i in range(200)], f"ordinal long, chunk_id string, text string, {', '.join(f'{c} string' for c in METADATA)}")
    one = lambda x: (chunking.fingerprint_tree(x).first()[0], chunking.metadata_fingerprint_tree(x).first()[0])
    now = one(rows)
    assert one(rows.repartition(7)) == now and all(len(x) == 16 for x in now)
    text, meta = one(rows.withColumn("text", F.upper("text"))), one(rows.withColumn("kind", F.lit("k")))
    assert text[0] != now[0] and text[1] == now[1] and meta[0] == now[0] and meta[1] != now[1]
    assert len({one(x) for x in (rows, rows.limit(0), rows.where("ordinal < 199"), rows.withColumn("ordinal", -F.col("ordinal")))}) == 4


def test_vectors_that_are_no_vectors_take_no_place(spark):
    good = [(i, [1.0, float(i)]) for i in range(5)]
    nan, inf = float("nan"), float("inf")
    bad = [(10, [nan, 1.0]), (11, [nan, nan]), (12, [inf, 1.0]), (13, None), (14, []), (15, [1.0, None]), (16, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame([(i, i, v) for i, v in good + bad], "id long, ordinal long, v array<double>").coalesce(1)
    asked = spark.createDataFrame([(0, [1.0, 1.0]), (1, [nan, 1.0]), (2, None), (3, []), (4, [0.0, 0.0, 1.0])], "query_id long, v array<double>")
    got = dense.nearest(rows, asked, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(0, 1), (0, 2), (0, 3), (4, 16)]
    assert dense.nearest(rows, asked.limit(0), 3).count() == 0 and dense.nearest(rows.limit(0), asked, 3).count() == 0


def test_many_queries_in_blocks(spark, monkeypatch):
    """Queries beyond what goes to every task meet the vectors in blocks, with the same answers; and each within its own source."""
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((60, 8))
    rows = spark.createDataFrame([(f"v{i}", i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "id string, ordinal long, v array<double>, source string").repartition(4)
    asked = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(q)], "query_id long, v array<double>, within string")
    plain = lambda within: sorted(tuple(r) for r in dense.nearest(rows, asked, 5, None, within).select("query_id", "id", "score", "rank").collect())
    whole = {w: plain(w) for w in (None, "source")}
    assert all(int(i[1:]) % 2 == k % 2 for k, i, _, _ in whole["source"]) and len(whole["source"]) == len(whole[None]) == 300
    monkeypatch.setattr(dense, "QUERY_BYTES", 1000)
    monkeypatch.setattr(dense, "GROUP_VECTORS", 70)
    assert {w: plain(w) for w in (None, "source")} == whole


def test_cells_find_nine_tenths(spark, tmp_path):
    """Every vector is in the index, and the measured recall against exact neighbours is above 0.9 at a sixteenth of the cells."""
    rng = np.random.default_rng(9)
    middle = rng.standard_normal((150, 32))
    x = middle[rng.integers(0, 150, 6000)] + 0.5 * rng.standard_normal((6000, 32))
    rows = spark.createDataFrame([(i, i, v, i % 3) for i, v in enumerate(x.tolist())] + [(9000, 9000, [float("nan")] * 32, 0)], "id long, ordinal long, v array<double>, kind int").repartition(4)
    asked = rows.where("id % 20 = 0 AND id < 9000").select(F.col("id").alias("query_id"), "v")
    cells = dense.CellIndex(spark, str(tmp_path / "cells"))
    cells.build(rows, cells=64)
    assert spark.read.parquet(str(tmp_path / "cells/vectors")).count() == 6000
    exact = {(r["query_id"], r["id"]) for r in dense.nearest(rows, asked, 10).collect()}
    recall = {p: len(exact & {(r["query_id"], r["id"]) for r in cells.search(asked, 10, p).collect()}) / len(exact) for p in (4, 64)}
    assert recall[64] == 1.0 and recall[4] >= 0.9
    only = cells.search(asked, 3, 64, F.col("kind") == 1).collect()
    assert {r["id"] % 3 for r in only} == {1} and len(only) == 900


def test_search_prunes_terms_before_they_become_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"river lake bank{i} water{i % 5} permits") for i in range(40)], "id long, text string")
    asked = spark.createDataFrame([(0, "water1 river bank7"), (1, "nothing"), (2, "")], "query_id long, q string")
    index = lexical.build(docs, "id", "text")
    assert {r["term"] for r in lexical._wanted(index, ["river", "bank7"]).postings.collect()} == {"river", "bank7"}
    few = sorted(map(tuple, lexical.search(index, asked, 5).collect()))
    monkeypatch.setattr(lexical, "MOST_WANTED", 0)
    assert sorted(map(tuple, lexical.search(index, asked, 5).collect())) == few and len(few) == 5


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return self

        def get(self, key):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        staging.shared_dir(Session())
    kept = staging.materialize(spark.range(5), "five")
    path = kept.inputFiles()[0]
    assert path.startswith(staging.shared_dir(spark).replace("file://", "file:")) or "/strandlake" in path
    staging.discard(kept)
    assert not os.path.exists(path.removeprefix("file://"))


#: The folder of a corpus with labelled questions.
GOLD = os.environ.get("STRANDLAKE_CORPUS", "")


@pytest.mark.skipif(not os.path.isdir(GOLD), reason="STRANDLAKE_CORPUS names no folder")
def test_published_quality(spark):
    """The labelled questions over the shipped corpus: the published offline figures, exactly."""
    from strandlake.operators import fusion
    from strandlake.sources.gold import read_gold
    from strandlake.sources.markdown import lines_of, read_markdown
    from strandlake.sources.policies import read_policies

    chunks = chunking.corpus(chunking.chunk_regulations(lines_of(read_markdown(spark, f"{GOLD}/regulations"))), chunking.chunk_policies(read_policies(spark, glob.glob(f"{GOLD}/policies/*.csv")[0]))).cache()
    assert [(r["source"], r["n_chunks"]) for r in chunking.counts_by_source(chunks).collect()][-1] == ("policy_register", 12) and chunks.count() == 845
    embedder = dense.HashingEmbedder()
    vectors = chunks.select(F.col("chunk_id").alias("id"), "ordinal", embedder.documents(F.col("text")).alias("v"), "kind", "source")
    retriever = fusion.Retriever(lexical.build(chunks, "chunk_id", "text", "ordinal", ("kind", "source")), vectors, embedder)
    ranks = evaluate.run(retriever, read_gold(spark, glob.glob(f"{GOLD}/eval/*.json")[0]), chunks)
    got = {r["mode"]: r for r in evaluate.metrics(ranks).where("grp = 'all'").collect()}
    for mode, hits, mrr in (("bm25", (34, 41, 42), 0.7597), ("dense", (29, 38, 39), 0.6836), ("hybrid", (33, 39, 43), 0.7434)):
        r = got[mode]
        assert tuple(round(50 * r[f"recall_at_{k}"]) for k in (1, 3, 5)) == hits and round(r["mrr"], 4) == mrr, mode
    chunks.unpersist()
