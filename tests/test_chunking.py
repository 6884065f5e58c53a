from pyspark.sql import functions as F

from strandlake.operators import chunking
from strandlake.sources.gold import read_gold
from strandlake.sources.markdown import lines_of, read_markdown
from strandlake.sources.policies import read_policies

LAW = """# Water Act — on rivers

> a notice
## CHAPTER I — Rivers

preamble is left out
### Article 1 — Names

1. First rule
(a) point one
  (i) deeper
# a remark
(b) point two

Second rule without a number

Third one

## CHAPTER II — Lakes

### Article 2 — Long

3. The list has these parts:
""" + "\n".join(f"({i}) " + "word " * 60 for i in range(20)) + "\n"


def chunks(spark, text=LAW, source="water_act"):
    made = chunking.chunk_regulations(lines_of(spark.createDataFrame([(source, text)], "source string, value string")))
    return {r["chunk_id"]: r for r in made.collect()}


def test_ids_headers_and_chapters(spark):
    found = chunks(spark)
    one = found["water_act::art1::p1"]
    assert one["body"] == "1. First rule\n(a) point one\n  (i) deeper\n(b) point two"
    assert one["text"].startswith("Water Act — Article 1: Names\nCHAPTER I — Rivers\n\n1. First")
    assert one["citation"] == "Water Act Art. 1(1)"
    assert {"water_act::art1::s1", "water_act::art1::s2"} <= set(found)
    assert found["water_act::art1::s2"]["chapter"] == "CHAPTER I — Rivers"
    assert "preamble" not in "".join(r["body"] for r in found.values())


def test_long_paragraphs_are_split_and_keep_their_lead(spark):
    parts = {k: r for k, r in chunks(spark).items() if k.startswith("water_act::art2::p3.")}
    assert len(parts) == 4
    for k, r in parts.items():
        assert r["body"].startswith("3. The list has these parts:\n") and len(r["body"]) <= 2000, k
    assert sum(r["body"].count("word") for r in parts.values()) == 20 * 60


def brute_split(lines):
    if sum(len(x) + 1 for x in lines) <= 2000:
        return [lines]
    lead, out, now = lines[0] if len(lines[0]) <= 400 else None, [], []
    for x in lines:
        if now and sum(len(y) + 1 for y in now) + len(x) + 1 > 2000:
            out.append(now)
            now = [lead] if lead else []
        now = [*now, x]
    return [*out, now]


def test_split_matches_a_plain_loop(spark):
    cases = [["a" * n for n in sizes] for sizes in ([10], [401, 1700, 1700], [400, 1700, 10, 1800], [1990, 30, 5], [1999], [100] * 50)]
    rows = spark.createDataFrame([(x,) for x in cases], "lines array<string>").select("lines", chunking.split_block(F.col("lines")).alias("p")).collect()
    for r in rows:
        assert r["p"] == brute_split(r["lines"])


def test_overlong_lines_are_cut_at_sentences(spark):
    line = " ".join(f"Sentence {i} has some words;" for i in range(150))
    got = spark.createDataFrame([([line],)], "lines array<string>").select(chunking.hard_wrap(F.col("lines")).alias("x")).first()["x"]
    assert len(got) > 1 and all(len(x) <= 2000 for x in got) and " ".join(got) == line


def test_equal_article_numbers_stay_apart(spark):
    found = chunking.chunk_regulations(lines_of(spark.createDataFrame([("x", "### Article 1 — A\n\none\n\n### Article 1 — B\n\ntwo\n")], "source string, value string"))).collect()
    assert sorted((r["article_title"], r["body"]) for r in found) == [("A", "one"), ("B", "two")] and found[0]["citation"] == "X Art. 1"


def test_files_register_corpus_and_outline(spark, tmp_path):
    (tmp_path / "water_act.md").write_text(LAW)
    (tmp_path / "air.md").write_text("# Air — x\n\n### Article 1 — Air\n\n1. Breathe\n")
    (tmp_path / "p.csv").write_text('policy_id,title,owner,last_reviewed,summary\n P-1 ,Access,CISO,2024-01-02,"Who, when"\nP-2,Data,CDO,2023-01-01,lost, here\n')
    pol = read_policies(spark, str(tmp_path / "p.csv"))
    rows = {r["policy_id"].strip(): r for r in pol.collect()}
    assert rows["P-1"]["summary"] == "Who, when" and rows["P-2"]["summary"] == "lost" and "here" in rows["P-2"]["_corrupt_record"]
    every = chunking.corpus(chunking.chunk_regulations(lines_of(read_markdown(spark, str(tmp_path)))), chunking.chunk_policies(pol)).cache()
    ids = [r["chunk_id"] for r in every.orderBy("ordinal").collect()]
    assert ids[0] == "air::art1::p1" and ids[-2:] == ["policy::P-1", "policy::P-2"] and len(set(ids)) == len(ids)
    assert [(r["source"], r["n_chunks"]) for r in chunking.counts_by_source(every).collect()] == [("air", 1), ("policy_register", 2), ("water_act", 7)]
    assert [r[0] for r in chunking.regulation_sources(every).collect()] == ["air", "water_act"]
    outline = chunking.outline(every.where("source = 'water_act'")).first()["outline"]
    assert outline == "CHAPTER I — Rivers\n  Article 1 — Names\n\nCHAPTER II — Lakes\n  Article 2 — Long"
    fp = chunking.fingerprint(every).first()[0]
    assert len(fp) == 16 and fp == chunking.fingerprint(every.repartition(3)).first()[0] != chunking.fingerprint(every.where("ordinal > 0 AND chunk_id <> 'policy::P-2'")).first()[0]
    assert chunking.fingerprint_tree(every).first()[0] == chunking.fingerprint_tree(every.repartition(3)).first()[0]
    assert chunking.metadata_fingerprint(every).first()[0] != chunking.metadata_fingerprint(every.withColumn("citation", F.lit("x"))).first()[0]


def test_gold(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"_about": "x", "cases": [{"source": "a", "q": "why", "articles": ["1"], "type": "exact"}, {"source": "b", "q": "how", "articles": ["2", "3"]}]}')
    assert [(r["query_id"], r["type"], r["articles"]) for r in read_gold(spark, str(tmp_path / "g.json")).orderBy("query_id").collect()] == [(0, "exact", ["1"]), (1, "paraphrase", ["2", "3"])]
