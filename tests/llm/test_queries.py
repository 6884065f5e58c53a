"""The queries that SQL can't express, over whole made tables, and the pipeline on awkward ones."""

import random
import zlib

import corpus_pipeline
import public_tokenizers as P
import pytest
import test_packing as K
import test_toxicity as X
from tokenizers import Tokenizer

from strandlake import llm

ODD = [(9001, None), (9002, ""), (9003, "\n\n"), (9004, "a<|endoftext|>b é日"), (None, "without a number")]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, __row long, row string, `a.b` string, score double, uid string"


def written(spark, at, docs, labels, items, schema=DOCUMENTS):
    extra = [(i, t, "en", "s", None if t is None else len(t), 7, "r", "x", 0.5, "u")[: len(schema.split(", "))] for i, t in docs]
    spark.createDataFrame(extra, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def made(spark, make, tmp_path_factory):
    """Prose of which every fifth document is toxic, near copies, benchmark passages, a shared line, a long text and odd rows."""
    corpus, w, rng = X.corpus(make), make(31), random.Random(31)
    line, passage = w(12), w(40)
    docs = [(i, t + ("\n" + line if i % 7 == 1 else "")) for i, t, _ in corpus]
    base = w(150).split()
    docs += [(1000 + k, " ".join(x if j != 10 * k else "changed" for j, x in enumerate(base))) for k in range(4)]
    docs += [(1100, " ".join(base)), (1101, " ".join(base)), (1200, f"{w(2000)} {passage} {w(2000)}"), (1201, f"{w(30)} {passage}"), (1300, w(9000))]
    docs += ODD + [(1400, rng.choice(ODD)[1] or "x"), (1400, "a row with a number that is there already")]
    return written(spark, tmp_path_factory.mktemp("queries"), docs, [(i, 1, y) for i, _, y in corpus], [(1, passage), (2, None), (3, "")]), docs, corpus


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("bare"), [], [], [])


def test_op2_query(spark, made):
    at, docs, corpus = made
    got = llm.queries()["op2_toxicity"](spark, at).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(i) for i, _ in docs)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by_doc, truth = {r["doc_id"]: r for r in got}, {i: y for i, _, y in corpus}
    right = [by_doc[i]["predicted"] == y for i, y in truth.items() if by_doc[i]["held_out"]]
    assert len(right) > 60 and sum(right) > 0.97 * len(right) and not any(by_doc[i]["predicted"] for i, _ in ODD)


def test_op7_query(spark, made):
    at, docs, _ = made
    docs = [(i, t) for i, t in docs if i != 1400]  # its number is there twice
    rows = [r for r in llm.queries()["op7_packing"](spark, at).collect()]
    assert sum(r["doc_id"] == 1400 and r["start"] == 0 for r in rows) == 2
    total = sum(r["length"] for r in rows)
    ids = {r["doc_id"] for r in rows}
    assert ids == {i for i, _ in docs} | {1400}
    sequences = K.valid(rows, docs, 4096)
    assert -(-total // 4096) <= sequences <= -(-total // 4096) + 2


def test_op8_query(spark, made):
    at, docs, _ = made
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in docs), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in llm.queries()["op8_token_counts"](spark, at).collect()), key=repr) == want


def test_pipeline_on_awkward_rows(spark, made):
    at, docs, corpus = made
    rows = corpus_pipeline.run(spark, at).collect()
    kept = [r["doc_id"] for r in rows if r["start"] == 0]
    toxic = {i for i, _, y in corpus if y}
    assert len(toxic & set(kept)) <= 0.03 * len(toxic)
    clean = {i for i, _, y in corpus if not y}
    assert len(clean - set(kept)) <= 0.01 * len(clean)
    assert {1000, 1001, 1002, 1003, 1100, 1101} & set(kept) == {1000} and not {1200, 1201} & set(kept)
    assert {i for i, _ in ODD} | {1300} <= set(kept) and kept.count(1400) == 2


def test_pipeline_without_rows_or_optional_columns(spark, bare, tmp_path):
    assert corpus_pipeline.run(spark, bare).count() == 0
    few = written(spark, tmp_path, [(1, "one two"), (2, None)], [], [], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, few).collect()} == {1, 2}


@pytest.mark.parametrize("name", ["op2_toxicity", "op7_packing", "op8_token_counts"])
def test_no_rows(spark, bare, name):
    assert llm.queries()[name](spark, bare).count() == 0
