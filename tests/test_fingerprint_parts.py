"""The query of fingerprints deals chunks into more parts as it reads more."""

from pyspark.sql import functions as F

from strandlake.plans import table_queries


def test_parts_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(120).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(3).select(F.col("id").alias("item_id")).write.parquet(str(tmp_path / "benchmark.parquet"))
    kind, dealt = type(spark.range(1)), []
    monkeypatch.setattr(kind, "repartition", lambda self, n, *c, f=kind.repartition: dealt.append((n, self.rdd.getNumPartitions())) or f(self, n, *c))
    got = table_queries.a13_fingerprint_tree(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(0, True, True, True, True)]
    assert all(n > read for n, read in dealt) and dealt
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        table_queries.a13_fingerprint_tree(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert dealt[-1][0] > dealt[-1][1] >= 12
