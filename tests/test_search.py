import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions.text import STOP_WORDS
from strandlake.operators import dense, evaluate, fusion, lexical

random.seed(3)
WORDS = "river lake water permits incident report bank audit outage the of and".split()
DOCS = [(i, " ".join(random.choice(WORDS) for _ in range(random.randint(0, 30))), "ab"[i % 2], "xyz"[i % 3]) for i in range(60)]
QUERIES = [(0, "water permits water"), (1, "the of"), (2, "incident reports"), (3, "nothing here")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, text string, kind string, source string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, q string")


def tokens(text):
    found = [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP_WORDS]
    return [t[:-1] if len(t) > 4 and t.endswith("s") and not t.endswith("ss") else t for t in found]


def bm25(q, keep=lambda d: True):
    tf = [Counter(tokens(d[1])) for d in DOCS]
    n, avg = len(DOCS), sum(sum(c.values()) for c in tf) / len(DOCS)
    df = Counter(t for c in tf for t in c)
    scored = []
    for d, c in zip(DOCS, tf):
        s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for t in tokens(q) if c[t])
        if s > 0 and keep(d):
            scored.append((d[0], round(s, 9)))
    return sorted(scored, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("kind,source", [(None, None), ("a", None), ("b", "y")])
def test_bm25_counts_all_and_scores_what_passes(docs, asked, kind, source):
    index = lexical.build(docs, "id", "text", keep=("kind", "source"))
    got = lexical.search(index, asked, 7, fusion.filters(kind, source)).orderBy("query_id", "rank").collect()
    for k, q in QUERIES:
        want = bm25(q, lambda d: (not kind or d[2] == kind) and (not source or d[3] == source))[:7]
        assert [(r["id"], r["score"]) for r in got if r["query_id"] == k] == want


def test_index_is_the_same_when_kept(spark, docs, asked, tmp_path):
    index = lexical.build(docs, "id", "text", keep=("kind", "source"))
    lexical.save(index, str(tmp_path / "ix"))
    a, b = (lexical.search(i, asked, 5).orderBy("query_id", "rank").collect() for i in (index, lexical.load(spark, str(tmp_path / "ix"))))
    assert a == b


def test_empty_corpus(spark, asked):
    index = lexical.build(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert index.stats.first().asDict() == {"n_docs": 0, "avgdl": 0.0} and lexical.search(index, asked).count() == 0


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 6))
    x[10] = x[11]
    rows = spark.createDataFrame([(i, i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, ordinal long, v array<double>, side int").repartition(5)
    asked = spark.createDataFrame([(100 + i, x[i].tolist()) for i in (0, 10, 50)], "query_id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for where, keep in ((None, range(90)), (F.col("side") == 1, range(1, 90, 2))):
        got = dense.nearest(rows, asked, 4, where).orderBy("query_id", "rank").collect()
        for i in (0, 10, 50):
            want = sorted(keep, key=lambda j: (-round(float(unit[i] @ unit[j]), 9), j))[:4]
            assert [r["id"] for r in got if r["query_id"] == 100 + i] == want


def test_hashing_embedder(spark):
    e = dense.HashingEmbedder(64)
    rows = spark.createDataFrame([("Abc abc",), ("",), (None,), ("é",)], "t string").select(e.documents(F.col("t")).alias("v")).collect()
    assert abs(np.linalg.norm(rows[0]["v"]) - 1) < 1e-9 and not any(rows[1]["v"]) and not any(rows[2]["v"]) and not any(rows[3]["v"])
    assert e.name == "hashing:char3-5:64"


def test_remote_embedder_batches_and_normalises(spark):
    def call(texts, task):
        assert len(texts) <= 100
        return [[3.0, 4.0] if task == "document" else [0.0, 2.0] for _ in texts]

    e = dense.default_embedder(call, "m", 2)
    rows = spark.range(250).select(e.documents(F.col("id").cast("string")).alias("d"), e.queries(F.lit("x")).alias("q")).distinct().collect()
    assert [(r["d"], r["q"]) for r in rows] == [([0.6, 0.8], [0.0, 1.0])] and e.name == "remote:m:2"
    assert dense.default_embedder().name.startswith("hashing:")


def test_remote_embedder_tries_again_and_keeps_queries():
    asked, waits, fail = [], [], iter(["429: please retry in 2.5s", "503"])

    def call(texts, task):
        if (message := next(fail, None)) is not None:
            raise OSError(message)
        asked.append(list(texts))
        return [[float(len(t)), 1.0] for t in texts]

    e = dense.RemoteEmbedder("kept", 2, call, waits.append)
    a = e.vectors(["x", "yy", "x"], "query")
    assert waits == [3.5, 2.0] and asked == [["x", "yy"]] and (a[0] == a[2]).all()
    assert len(e.vectors(["yy", "zzz"], "query")) == 2 and asked[-1] == ["zzz"]
    assert len(e.vectors(["x", "x"], "document")) == 2 and asked[-1] == ["x", "x"]
    broken = dense.RemoteEmbedder("b", 2, lambda t, k: 1 / 0, waits.append)
    with pytest.raises(ZeroDivisionError):
        broken.vectors(["x"], "query")
    with pytest.raises(ValueError):
        dense.RemoteEmbedder("c", 2, lambda t, k: [], waits.append).vectors(["x"], "document")
    assert dense.seconds_to_wait("Retry in 1..2s", 9) == 60.0


def test_fusion_rewards_agreement_and_keeps_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, id string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "w", 2), (1, "x", 3)], "query_id long, id string, rank int")
    got = fusion.ranked(fusion.fuse({"bm25": a, "dense": b}), ["bm25", "dense"], 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["x", "z", "y", "w"]
    assert got[0]["score"] == round(1 / 61 + 1 / 63, 12) and (got[1]["bm25_rank"], got[1]["dense_rank"]) == (None, 1)


def test_modes(spark, docs, asked):
    e = dense.HashingEmbedder(128)
    vectors = docs.select("id", F.col("id").alias("ordinal"), "kind", "source", e.documents(F.col("text")).alias("v"))
    r = fusion.Retriever(lexical.build(docs, "id", "text", keep=("kind", "source")), vectors, e)
    assert r.search(asked, 50, "bm25").where("query_id = 0").count() <= 30
    hits = r.search(asked, 5, "hybrid", fusion.filters("a", None)).collect()
    assert {h["id"] % 2 for h in hits} == {0} and all(h["bm25_rank"] or h["dense_rank"] for h in hits)
    with pytest.raises(ValueError):
        r.search(asked, 5, "other")
    assert fusion.resolve_mode("auto", "hashing:x") == "hybrid" and fusion.resolve_mode("auto", "remote:x") == "dense"


def test_hits_without_a_chunk_fall_out_after_the_cut(spark):
    hits = spark.createDataFrame([(1, "a", 0.1, 1), (1, "gone", 0.05, 2)], "query_id long, id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "C 1", "T", "body"), ("b", "C 2", "", "other")], "chunk_id string, citation string, article_title string, body string")
    found = fusion.hydrate(hits, chunks)
    shown = fusion.formatted(spark.createDataFrame([(1,), (2,)], "query_id long"), found).orderBy("query_id").collect()
    assert [r["text"] for r in shown] == ["[a] C 1 — T\nbody", fusion.NO_HITS]


def test_measures(spark):
    ranks = spark.createDataFrame([("m", "exact", 1), ("m", "exact", 4), ("m", None, None), ("m", "paraphrase", 2)], "mode string, type string, rank int")
    got = {r["grp"]: r for r in evaluate.metrics(ranks).collect()}
    assert (got["all"]["n"], got["all"]["recall_at_1"], got["all"]["recall_at_3"], got["all"]["recall_at_5"], got["all"]["mrr"]) == (4, 0.25, 0.5, 0.75, 0.4375)
    assert got["paraphrase"]["n"] == 2 and got["paraphrase"]["mrr"] == 0.25
    assert evaluate.misses(ranks).count() == 1


def test_sound_labels(spark):
    cases = spark.createDataFrame([(1, "a", ["1", "9"])], "query_id long, source string, articles array<string>")
    chunks = spark.createDataFrame([("a", "1"), ("b", "9")], "source string, article string")
    assert [r["article"] for r in evaluate.unknown_labels(cases, chunks).collect()] == ["9"]
