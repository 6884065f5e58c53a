"""Search without a row for each pair of a query and a document: the same hits as ranking all scores, on awkward rows and in small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import lexical

rng = random.Random(7)
WORDS = [f"w{i}" for i in range(12)]
#: All hold "page"; equal texts tie; document 5 comes three times, twice the same, and one has no text.
DOCS = [(i, f"page page{i % 40:03d} " + " ".join(rng.choice(WORDS[: 3 + i % 9]) for _ in range(rng.randint(0, 12))), "ab"[i % 2]) for i in range(150)]
DOCS += [(5, DOCS[5][1], "b"), (5, "page w1 w1", "b"), (300, None, "a"), (301, "", "b")]
QUERIES = [(i, f"page page{i % 50:03d}") for i in range(60)] + [(100 + i, " ".join(rng.choice(WORDS) for _ in range(3)) + " w1 w1") for i in range(9)] + [(200, "the of"), (201, "unknown"), (202, None), (203, "page unknown")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, q, "ab"[i % 2]) for i, q in QUERIES], "query_id long, q string, within string")


def same(found, want):
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect())
    assert got == sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in want.collect()) and got
    return got


@pytest.mark.parametrize("rare,pairs,most,repeated", [(6, 40, 500_000, True), (0, 1 << 20, 120, False)])
def test_same_as_ranking_all_scores(spark, asked, monkeypatch, tmp_path, rare, pairs, most, repeated):
    docs = spark.createDataFrame([d for d in DOCS if repeated or d not in DOCS[150:152]], "id long, text string, kind string").repartition(3)
    index = lexical.build(docs, "id", "text", keep=("kind",))
    lexical.save(index, str(tmp_path / "ix"))
    ways = [(None, None), (F.col("kind") == "a", None), (None, "kind")]
    every = [lexical.top(lexical.scores(index, asked, w, n), 4).collect() for w, n in ways]
    for name, value in (("RARE", rare), ("MOST_PAIRS", pairs), ("MOST_ASKED", most)):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical, "scores", None)  # no row for each pair
    for (w, n), rows in zip(ways, every, strict=True):
        for either in (index, lexical.load(spark, str(tmp_path / "ix"))):
            same(lexical.search(either, asked, 4, w, n), spark.createDataFrame(rows))
    assert lexical.search(index, asked.limit(0), 4).count() == 0


def test_common_terms_are_scored_once_for_all_queries(spark):
    """Queries that share their common terms are one group, and what a task hands on doesn't grow with pairs."""
    n = 1200
    docs = spark.createDataFrame([(i, f"page number{i}") for i in range(n)], "id long, text string").coalesce(1)
    asked = spark.createDataFrame([(i, f"page number{i}") for i in range(0, n, 2)], "query_id long, q string")
    index = lexical.build(docs, "id", "text")
    wanted = lexical.query_terms(asked).withColumn("__key", F.lit("")).orderBy("query_id", "term", "__key").toArrow()
    terms = wanted.column("term").unique().sort()
    rows, df, n_docs, avgdl = lexical._packed_tokens(index, terms, None, None)
    plan = lexical._Plan(wanted, terms, df, n_docs, avgdl, 4)
    assert (plan.groups, plan.queries, plan.shared) == (1, n // 2, True)
    handed = rows.mapInArrow(lexical._scored(spark.sparkContext.broadcast(plan)), "slot long, id long, ordinal long, score double").count()
    assert handed <= (n // 2 + 4) * 8
    got = {(r["query_id"], r["rank"]): r["id"] for r in lexical.search(index, asked, 4).collect()}
    assert all([got[q, k] for k in (1, 2, 3, 4)] == [q, *[i for i in range(4) if i != q][:3]] for q in range(0, n, 2))


@pytest.mark.parametrize("repeated", [False, True])
def test_postings_are_counted_where_the_tokens_are(spark, repeated):
    docs = spark.createDataFrame([d for d in DOCS if repeated or d not in DOCS[150:152]] + [(400 + i, "é " * i + "Words words wordss x9", None) for i in range(3)], "id long, text string, kind string").repartition(3)
    index = lexical.build(docs, "id", "text", keep=("kind",))
    found, want = lexical.counted(index.tokens, ("kind",)), lexical.postings_of(index.tokens, ("kind",))
    names = ["id", "ordinal", "dl", "kind", "term", "tf"]
    rows = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert rows(found) == rows(want) and found.schema["tf"].dataType == want.schema["tf"].dataType
    assert repeated or "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_postings_of_a_common_term_take_several_files(spark, tmp_path):
    docs = spark.range(4000).select("id", F.lit("page").alias("text"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lexical.save(lexical.build(docs, "id", "text"), str(tmp_path / "ix"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    rows = spark.read.parquet(str(tmp_path / "ix/postings")).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in rows) == 4000 and len(rows) == 4 and max(r["count"] for r in rows) < 2000
