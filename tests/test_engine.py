"""Index, knowledge base, workflow, streams, command line and settings on a small corpus."""

import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.operators import dense, index
from strandlake.operators.chunking import chunk_policies
from strandlake.plans.knowledge_base import KnowledgeBase
from strandlake.plans.workflow import DONE, END_TOKEN, WAITING, Run
from strandlake.sources.config import Settings
from strandlake.streaming import logs

LAW = "# Bank Act — x\n\n## CHAPTER I — Reports\n\n### Article 1 — Incidents\n\n1. Banks report incidents within a day.\n\n2. Outages of rivers are reported.\n\n### Article 2 — Audits\n\n1. Auditors check permits.\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("kb")
    (at / "regs").mkdir()
    (at / "regs/bank_act.md").write_text(LAW)
    (at / "p.csv").write_text("policy_id,title,owner,last_reviewed,summary\nP-1,Incident Standard,IT,2024-01-01,Severity of incidents\n")
    return at


@pytest.fixture(scope="module")
def kb(spark, folder):
    return KnowledgeBase.load(spark, str(folder / "regs"), str(folder / "p.csv"), str(folder / "index"))


def test_search_and_facade(kb):
    hits = kb.search_regulation("incident report", "bank_act", 2).orderBy("rank").collect()
    assert hits[0]["chunk_id"] == "bank_act::art1::p1" and {h["source"] for h in hits} == {"bank_act"}
    assert [h["chunk_id"] for h in kb.search_policies("incidents").collect()] == ["policy::P-1"]
    assert kb.get("bank_act::art2::p1").first()["citation"] == "Bank Act Art. 2(1)" and kb.get("x").count() == 0
    assert kb.outline("bank_act").first()["outline"].endswith("Article 2 — Audits") and kb.sources().count() == 1
    texts, log = kb.provision(["[bank_act::art1::p2]", "nope"], "r")
    assert {r["query_id"]: r["text"][:20] for r in texts.collect()} == {0: "[bank_act::art1::p2]", 1: "No provision nope."[:20]}
    assert log.where("size(chunk_ids) = 1").count() == 1


def test_index_is_reused_synced_and_rebuilt(spark, kb, tmp_path):
    chunks = kb.chunks
    built = index.Index(spark, str(tmp_path / "ix"), dense.HashingEmbedder(32))
    assert built.info() is None and not built.is_fresh("x", 1)
    with pytest.raises(RuntimeError):
        built.chunks()
    assert built.refresh(chunks) == "built" and built.refresh(chunks) == "reused"
    renamed = chunks.withColumn("citation", F.concat(F.col("citation"), F.lit("!")))
    assert built.refresh(renamed) == "synced" and built.chunks().first()["citation"].endswith("!")
    assert built.vectors().count() == chunks.count() and built.info()["n_chunks"] == chunks.count()
    assert built.refresh(chunks.withColumn("text", F.concat(F.col("text"), F.lit("?")))) == "built"
    assert built.refresh(chunks, rebuild=True) == "built"
    other = index.Index(spark, str(tmp_path / "ix"), dense.HashingEmbedder(16))
    assert other.info() is None and other.root != built.root


def fake(prompt, text):
    return {"triage": '["incidents", "audits"]', "research": "Report fast [bank_act::art1::p1]. Made up [bank_act::art9::p9].", "draft": "# R\nReport [bank_act::art1::p1] and [bank_act::art9::p9].", "revise": "# R2\nReport [bank_act::art1::p1]."}.get(prompt) or (f"done {END_TOKEN}" if prompt == "review:Editor" else "say more")


def test_a_run_with_one_revision(spark, kb):
    failures = iter([True])

    def model(prompt, text):
        if prompt == "draft" and next(failures, False):
            raise OSError("once")
        return fake(prompt, text)

    run = Run(kb, model, "r1", "bank_act", "Bank Act", wait=lambda s: None)
    payload = run.start()
    assert run.state["status"] == WAITING and payload["revision_count"] == 0 and run.state["themes"] == ["incidents", "audits"]
    assert run.state["citation_report"]["verified"] == ["bank_act::art1::p1"] and run.state["citation_report"]["unknown"] == ["bank_act::art9::p9"]
    assert run.state["committee_redlines"] == "done"
    assert run.stored().first()["status"] == WAITING
    assert run.resume("shorter please")["revision_count"] == 1
    assert run.resume("Approved") is None and run.state["status"] == DONE
    assert run.state["final_report"].startswith("# R2\nReport [Bank Act Art. 1(1)].") and run.state["final_citation_report"]["grounded_ratio"] == 1.0
    assert [r["tool"] for r in run.log.orderBy("seq").collect()] == ["search_regulation"] * 2 + ["search_policies"] * 2 + ["review_evidence"] * 2
    with pytest.raises(ValueError):
        run.resume("again")


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/bank_act.md").write_text(LAW)
    for n in (3, 4):
        logs.chunk_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert logs.newest_chunks(spark, str(tmp_path / "out")).count() == n
        (tmp_path / "in" / f"bank_act{'' if n > 3 else '2'}.md").write_text("# B — y\n\n### Article 1 — New\n\n1. Only this.\n")
    rows = [("r", 1, "search", "q", ["a", "b"]), ("r", 2, "review_evidence", "q", ["c"]), ("r", 3, "search", "q", ["a"])]
    spark.createDataFrame(rows, logs.LOG).write.parquet(str(tmp_path / "log"))
    read = logs.retrieved_stream(logs.log_stream(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("read_ids").outputMode("append").trigger(availableNow=True).start()
    read.awaitTermination()
    assert sorted(r["chunk_id"] for r in spark.table("read_ids").collect()) == ["a", "b"]


def test_command_line_and_settings(spark, folder, tmp_path, capsys):
    for k, v in (("regulations_dir", folder / "regs"), ("policies_csv", folder / "p.csv"), ("index_dir", folder / "index"), ("embed_dim", 7)):
        spark.conf.set(f"spark.strandlake.{k}", str(v))
    assert Settings.load(spark).embed_dim == 7 and Settings.load(spark).retrieval_mode == "auto"
    (tmp_path / "g.json").write_text('{"cases": [{"source": "bank_act", "q": "incidents report", "articles": ["1"]}]}')
    for args in (["index"], ["search", "incidents", "--source", "policies"], ["eval", "--gold", str(tmp_path / "g.json")]):
        cli.main(args, spark)
    shown = capsys.readouterr().out
    assert "policy::P-1" in shown and "recall_at_1" in shown and "hashing:char3-5" in shown


def test_policy_rows_with_nulls(spark):
    rows = spark.createDataFrame([("P-9", "T", None, None, None)], "policy_id string, title string, owner string, last_reviewed string, summary string")
    assert chunk_policies(rows).first()["body"] == "Owner: . Last reviewed: .\n"


def test_research_with_tools(spark, kb):
    """Rounds of calls, a checker that looks up for itself, files; the log has what was read, and the file is the findings."""
    prompts = []
    rounds = iter([
        '[{"tool": "search_regulation", "query": "incidents"}, {"tool": "search_policies", "query": "severity"}, {"tool": "search_regulation", "query": "audits"}, {"tool": "dance"}]',
        '{"tool": "check_claim", "claim": "A day", "id": "bank_act::art1::p1"}',
        '{"tool": "write_file", "name": "/root/work/findings.md", "content": "Report [bank_act::art1::p1]."}',
        "I have done.",
    ])
    checks = iter(['{"tool": "get_provision", "id": "[bank_act::art2::p1]"}', "SUPPORTED"])

    def model(prompt, text):
        prompts.append((prompt, text))
        return next(rounds) if prompt == "research" else next(checks) if prompt == "check" else fake(prompt, text)

    run = Run(kb, model, "r9", "bank_act", "Bank Act", wait=lambda s: None)
    run.triage()
    run.research()
    assert run.state["research_findings"] == "Report [bank_act::art1::p1]." and list(run.state["research_files"]) == ["/root/work/findings.md"]
    log = run.log.where("run_id = 'r9'").orderBy("seq").collect()
    assert [r["tool"] for r in log] == ["search_regulation"] * 2 + ["search_policies"] * 2 + ["search_regulation"] * 2 + ["search_policies"] + ["get_provision"] * 2
    assert [r["seq"] for r in log] == list(range(len(log))) and [r["query"] for r in log[4:7]] == ["incidents", "audits", "severity"]
    second = [t for p, t in prompts if p == "research"][1]
    assert "[policy::P-1]" in second and "no tool 'dance'" in second and "SUPPORTED" in [t for p, t in prompts if p == "research"][2]
    assert "Auditors check permits" in [t for p, t in prompts if p == "check"][1]


def test_research_ends_after_so_many_rounds(spark, kb, monkeypatch):
    monkeypatch.setattr("strandlake.plans.workflow.MOST_ROUNDS", 3)
    run = Run(kb, lambda p, t: '{"tool": "write_file", "name": "n.md", "content": "x"}' if p == "research" else fake(p, t), "r10", "bank_act", "Bank Act")
    run.triage()
    run.research()
    assert "write_file" in run.state["research_findings"] and list(run.state["research_files"]) == ["n.md"]


def test_a_run_from_the_command_line_writes_its_outputs(spark, folder, tmp_path, capsys, monkeypatch):
    for k, v in (("regulations_dir", folder / "regs"), ("policies_csv", folder / "p.csv"), ("index_dir", folder / "index"), ("output_dir", tmp_path / "out")):
        spark.conf.set(f"spark.strandlake.{k}", str(v))
    monkeypatch.setattr("test_engine.fake", fake, raising=False)
    import sys

    sys.modules.setdefault("a_model", type(sys)("a_model")).answer = lambda p, t: '{"tool": "write_file", "name": "a/notes.md", "content": "n"}' if p == "research" and "notes" not in t else fake(p, t)
    cli.main(["run", "--source", "bank_act", "--name", "Bank Act", "--model", "a_model:answer", "--approve"], spark)
    (at,) = (tmp_path / "out").iterdir()
    assert at.name.startswith("bank_act-") and f"Written to {at}" in capsys.readouterr().out
    report = spark.read.text(f"{at}/report", wholetext=True).first()["value"]
    assert report.startswith("# R\nReport [Bank Act Art. 1(1)]") and "say more" in spark.read.text(f"{at}/transcript", wholetext=True).first()["value"]
    log = spark.read.json(f"{at}/retrieval_log").orderBy("seq").collect()
    assert [r["seq"] for r in log] == list(range(len(log))) and log[-1]["tool"] == "review_evidence"
    both = spark.read.json(f"{at}/citation_report").first()
    assert both["research_findings"]["verified"] == ["bank_act::art1::p1"] and both["final_report"]["unknown"] == ["bank_act::art9::p9"]
    files = {r["name"]: r["value"] for r in spark.read.text(f"{at}/research_files", wholetext=True).collect()}
    assert files == {"notes.md": "n\n"}


def test_markdown_files_are_read_as_written(spark, tmp_path):
    from strandlake.sources.markdown import read_markdown, write_markdown

    at = f"file://{tmp_path}/laws"
    texts = [("act", "# Act — one\n\ntext"), ("an act = 50%", "é\n"), ("none", "")]
    rows = spark.createDataFrame(texts, "source string, value string")
    write_markdown(rows, at)
    write_markdown(rows.where("source = 'act'").withColumn("value", F.lit("two\n\n")), at)
    got = {r["source"]: r["value"] for r in read_markdown(spark, at).collect()}
    assert got == {"act": "two\n\n", "an act = 50%": "é\n", "none": "\n"}
    assert sorted(x.name for x in (tmp_path / "laws").iterdir() if not x.name.startswith(".")) == ["act.md", "an act = 50%.md", "none.md"]
