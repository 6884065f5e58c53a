"""Blocks read from whole texts are those that windows over lines give, on awkward texts."""

import random

from pyspark.sql import functions as F

from strandlake.operators import chunking
from strandlake.sources.markdown import lines_of

PIECES = ["# Law — of", "# ", "#", "## Chapter I ", "##", "## ", "### Article 1 — A", "### Article 2b —  B — c ", "### Article", "### Article x y — z", " ### Article 3 — no", "1. one", "12. em", "12.\tx", "(a) two  ", "> note", " > text", "", " ", " ", "　", "plain  ", "é. ü", "x" * 30]
ENDS = ["\n", "\r\n", "\r", "\x0b", "\x1d", "\u0085", " ", "\n\n"]


def texts(spark):
    rng = random.Random(5)
    rows = [(f"d{i:03d}", "".join(rng.choice(PIECES) + rng.choice(ENDS[: 1 + i % 8]) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [("none", None), ("empty", ""), ("straße", "### Article 1 — A\n\nx")]
    return spark.createDataFrame(rows, "source string, value string")


def test_same_as_windows(spark):
    t = texts(spark)
    columns = ["source", "art_ord", "chapter", "article", "article_title", "block", "lines", "number", "__n", "name"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    got = rows(chunking.text_blocks(t))
    assert got == rows(chunking._placed(lines_of(t))) and len(got) > 200
    assert sorted(map(tuple, chunking.chunk_texts(t).collect())) == sorted(map(tuple, chunking.chunk_regulations(lines_of(t)).collect()))


def test_texts_are_not_shuffled_unless_a_source_has_several(spark):
    t = texts(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(chunking.text_blocks(t)) and "Window" not in plan(chunking.text_blocks(t))
    twice = t.where("source < 'd003'").unionByName(t.where("source = 'd001'").withColumn("value", F.lit("\n" * 500 + "1. late")))
    assert sorted(map(tuple, chunking.chunk_texts(twice).collect())) == sorted(map(tuple, chunking.chunk_regulations(lines_of(twice)).collect()))


def test_a_corpus_has_the_columns_that_are_asked_for(spark):
    t = texts(spark)
    pol = spark.createDataFrame([("P-1", "T", None, None, "s")], "policy_id string, title string, owner string, last_reviewed string, summary string")
    whole, few = (chunking.corpus(chunking.chunk_texts(t), chunking.chunk_policies(pol), *c) for c in ([], [("chunk_id", "kind")]))
    assert few.columns == ["ordinal", "chunk_id", "kind"] and "text" in whole.columns
    assert sorted(map(tuple, whole.select(*few.columns).collect())) == sorted(map(tuple, few.collect()))
