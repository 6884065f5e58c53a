import pytest
from pyspark.sql import functions as F

from strandlake.operators import grounding, runlog
from strandlake.plans import outputs

CHUNKS = [(0, "law::art1::p1", "Law Art. 1(1)", "Names", "one"), (1, "law::art2::p1.1", "Law Art. 2(1)", "Long", "two a"), (2, "law::art2::p1.2", "Law Art. 2(1)", "Long", "two b"), (3, "policy::P-1", "P-1", "", "mine")]
TEXT = "A [law::art1::p1] b [law::art2::p1(b), law::art1::p1] c [law::art9::p9] d [x] e [Law::?]  "


@pytest.fixture(scope="module")
def data(spark):
    chunks = spark.createDataFrame(CHUNKS, "ordinal long, chunk_id string, citation string, article_title string, body string")
    texts = spark.createDataFrame([(1, TEXT), (2, "none"), (3, None)], "doc long, text string")
    read = spark.createDataFrame([(1, "law::art2::p1.2"), (2, "law::art1::p1")], "doc long, chunk_id string")
    return texts, chunks, read


def test_statuses(data):
    texts, chunks, read = data
    got = grounding.verify(grounding.extract(texts), chunks, read).orderBy("doc", "pos").collect()
    assert [(r["cid"], r["status"]) for r in got] == [("law::art1::p1", "not_retrieved"), ("law::art2::p1", "verified"), ("law::art9::p9", "unknown"), ("Law::?", "unknown")]
    report = {r["doc"]: r for r in grounding.report(grounding.verify(grounding.extract(texts), chunks, read), texts).collect()}
    assert (report[1]["verified"], report[1]["total"], report[1]["grounded_ratio"]) == (["law::art2::p1"], 4, 0.25)
    assert (report[2]["unknown"], report[2]["total"], report[2]["grounded_ratio"]) == ([], 0, 0.0)


def test_both_resolutions_agree(spark, data):
    _, chunks, _ = data
    cites = spark.createDataFrame([(c,) for c in ("law::art2::p1", "law::art2::p1.1", "law::art1::p1", "law::art2", "x")], "cid string")
    a, b = (sorted((r["cid"], r["chunk_id"] or "") for r in f(cites, chunks).collect()) for f in (grounding.resolve, grounding.resolve_prefix))
    assert a == b and ("law::art2::p1", "law::art2::p1.2") in a and ("law::art2::p1.1", "law::art2::p1.1") in a and ("law::art2", "") in a


def test_rendering(data):
    texts, chunks, read = data
    shown = {r["doc"]: r["rendered"] for r in grounding.render(texts, chunks, grounding.verify(grounding.extract(texts), chunks, read)).collect()}
    body, _, sources = shown[1].partition("\n\n## Sources\n\n")
    assert body == "A [Law Art. 1(1) — unverified] b [Law Art. 2(1)(b); Law Art. 1(1) — unverified] c [law::art9::p9 — unverified] d [x] e [Law::? — unverified]"
    assert "- Law Art. 2(1) — Long (`law::art2::p1`)\n" in sources and "- `law::art9::p9` — **not found in corpus**" in sources
    assert "— Names (`law::art1::p1`) — **cited but never retrieved**" in sources and sources.endswith("_Citation check: 1/4 citations verified against retrieved source text._\n")
    assert shown[2].startswith("none\n\n## Sources\n") and "0/0" in shown[2] and "0/0" in shown[3]


def test_evidence_is_ordered_once_and_bounded(spark, data):
    texts, chunks, _ = data
    got = {r["doc"]: r for r in grounding.evidence(texts, chunks).collect()}
    assert got[1]["chunk_ids"] == ["law::art1::p1", "law::art2::p1.1", "law::art2::p1.2"] and got[1]["text"].startswith("[law::art1::p1] Law Art. 1(1)\none\n\n[")
    assert got[2]["chunk_ids"] == [] and got[2]["text"] == ""
    assert len(grounding.evidence(texts, chunks, most=2).where("doc = 1").first()["chunk_ids"]) == 2


def test_provisions(spark, data):
    _, chunks, _ = data
    asked = spark.createDataFrame([(1, "[law::art2::p1]"), (2, "nope")], "query_id long, cid string")
    got = {r["query_id"]: r for r in grounding.provision(asked, chunks).collect()}
    assert got[1]["chunk_ids"] == ["law::art2::p1.1", "law::art2::p1.2"] and got[1]["text"].count("— Long") == 2
    assert got[2]["text"] is None and got[2]["chunk_ids"] == []


def test_evidence_never_counts_as_read(spark):
    log = spark.createDataFrame([("r", 1, "search_regulation", "q", ["a", "b"]), ("r", 2, "review_evidence", "q", ["c"]), ("r", 3, "get_provision", "q", ["a"])], "run_id string, seq long, tool string, query string, chunk_ids array<string>")
    assert sorted(r["chunk_id"] for r in runlog.retrieved(log).collect()) == ["a", "b"]
    assert runlog.append(log, log).count() == 6


def test_log_files(spark, tmp_path):
    queries = spark.createDataFrame([(0, "q0"), (1, "q1")], "query_id long, q string")
    hits = spark.createDataFrame([(0, "b", 2), (0, "a", 1)], "query_id long, id string, rank int")
    rows = runlog.entries(hits, queries, "search", "r")
    for _ in range(2):
        runlog.write(rows, str(tmp_path / "log"))
    got = runlog.read(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert len(got) == 4 and got[0]["chunk_ids"] == ["a", "b"] and got[3]["chunk_ids"] == []


def test_files(spark, tmp_path):
    files = {"/root/notes/x.md": ("X", "utf-8"), "y.md": ("Y", "utf-8"), "/z.md": ("Z", "utf-8")}
    row = spark.createDataFrame([("r", files)], "run_id string, files map<string,struct<content:string,encoding:string>>")
    for name, want in (("x.md", "X"), ("/y.md", "Y"), ("z.md", "Z"), ("none", None)):
        assert row.select(outputs.file_text(F.col("files"), name).alias("t")).first()["t"] == want
    assert {r["name"]: r["content"] for r in outputs.flattened(row).collect()} == {"x.md": "X", "y.md": "Y", "z.md": "Z"}
    bare = spark.createDataFrame([({"a": "t"},)], "f map<string,string>").select(outputs.plain_files(F.col("f")).alias("f"))
    assert bare.select(outputs.file_text(F.col("f"), "/a").alias("t")).first()["t"] == "t"
    run = row.select("run_id", "files", F.lit("# R\nbody").alias("final_report"), F.lit("said").alias("transcript"), F.array(F.struct(F.lit("t").alias("tool"), F.array(F.lit("a")).alias("chunk_ids"))).alias("log"), F.struct(F.array(F.lit("a")).alias("verified"), F.lit(1).alias("total")).alias("report"))
    outputs.persist(run, str(tmp_path / "out"))
    assert "# R" in spark.read.text(str(tmp_path / "out/report"), wholetext=True).first()["value"]
    assert spark.read.json(str(tmp_path / "out/citation_report")).first()["total"] == 1
    assert spark.read.text(str(tmp_path / "out/research_files")).count() == 3
