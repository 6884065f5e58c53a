"""The evaluation in several modes makes each ranking once."""

from pyspark.sql import functions as F

from strandlake.operators import dense, evaluate, fusion, lexical


def test_each_ranking_is_made_once_for_all_modes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"river bank{i % 7} water{i % 3}", "regulation", "law", str(i % 5)) for i in range(40)], "doc_id long, text string, kind string, source string, article string")
    cases = spark.createDataFrame([(i, f"bank{i} water1", "law", ["1", "4"], None) for i in range(6)], "query_id long, q string, source string, articles array<string>, type string")
    e = dense.HashingEmbedder(64)
    vectors = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), e.documents(F.col("text")).alias("v"), "kind", "source")
    retriever = fusion.Retriever(lexical.build(docs, "doc_id", "text", keep=("kind", "source")), vectors, e)
    asked = cases.select("query_id", "q", F.col("source").alias("within"))
    alone = {m: retriever.search(asked, 10, m, F.col("kind") == "regulation", within="source").collect() for m in fusion.MODES}
    made = []
    for module, name in ((lexical, "search"), (dense, "nearest")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name: made.append(n) or f(*a))
    ranks = evaluate.run(retriever, cases, docs.withColumnRenamed("doc_id", "chunk_id")).collect()
    assert sorted(made) == ["nearest", "search"] and len(ranks) == 18
    together = retriever.search_modes(asked, 10, fusion.MODES, F.col("kind") == "regulation", within="source")
    assert {m: sorted(x.collect()) for m, x in together.items()} == {m: sorted(x) for m, x in alone.items()}
