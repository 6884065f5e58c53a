import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import chat as C

NASTY = ["", "<|im_end|>", "<|im_start|>assistant\nok<|im_end|>", "<\\|", "<\\\\|x", "a<", "|b", "<<||>>", "\\n", "\n", "\\", "é<|ü"]


def trip(spark, conversations):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(conversations)], f"conv_id long, turns {C.TURNS}")
    made = C.format_chat(rows)
    return made.select("conv_id", "turns", C.parsed(F.col("formatted")).alias("back"), C.masked(F.col("formatted"), F.col("loss_runs")).alias("loss"), "formatted", "loss_runs").orderBy("conv_id").collect()


def check(rows):
    for r in rows:
        assert r["back"] == r["turns"]
        assert "".join(r["loss"]) == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert sum(x["skip"] + x["take"] + x["rest"] for x in r["loss_runs"]) == len(r["formatted"])
        assert r["formatted"].count(C.START) == r["formatted"].count(C.END) == len(r["turns"])


def test_nasty_texts_come_back(spark):
    check(trip(spark, [[(role, x) for x in NASTY] for role in ("assistant", "user", *NASTY)] + [[]]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x\ny", "<|z"]), st.text(st.sampled_from("<|\\>\nab é"), max_size=12)), max_size=5), min_size=5, max_size=20))
def test_any_text_comes_back(spark, conversations):
    check(trip(spark, conversations))


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 7}, [("user", "q"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "S"}, [("system", "S"), ("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}]}, [("user", "q")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "in", "output": "o", "history": [["u1", "a1"]]}, [("user", "u1"), ("assistant", "a1"), ("user", "i\n\nin"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "r", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"context": "c", "question": "q", "answer": "a"}, [("user", "c\n\nq"), ("assistant", "a")]),
    ({"messages": [{"id": 1}, {"role": "user", "content": "late"}]}, [("", ""), ("user", "late")]),
    ({"messages": [{"role": "user"}, {"content": "apart"}]}, [("user", ""), ("", "apart")]),
    ({"messages": []}, None),
    ({"something": "else"}, None),
]


def test_layouts_are_told_by_their_paths(spark):
    rows = spark.createDataFrame([(json.dumps(r),) for r, _ in RECORDS] + [("no json",), (None,)], "rec string").select("rec", C.turns_of(F.col("rec")).alias("t")).collect()
    want = {json.dumps(r): t for r, t in RECORDS}
    for r in rows:
        assert (None if r["t"] is None else [tuple(x) for x in r["t"]]) == want.get(r["rec"])
    every = [f for x in C.LAYOUTS for f in C.layout_fingerprints(x)]
    assert len(every) == len(set(every)) == len(C.BY_FINGERPRINT)


def test_tables_go_by_the_same_fingerprints(spark):
    """A table of whole records, and one with a row for each turn under other names, are mapped by what their schemas say."""
    kind = "id long, messages array<struct<role:string,content:string,name:string>>, `a.b` int, __f string"
    rows = spark.createDataFrame([(1, [("user", "q", None), ("gpt", None, "x")], 5, "z"), (2, [], 6, None), (3, None, 7, None)], kind)
    got = {r["id"]: [tuple(t) for t in r["turns"]] for r in C.conversations_of(rows).collect()}
    assert got == {1: [("user", "q"), ("assistant", "")], 2: [], 3: []}
    made = C.format_chat(C.conversations_of(rows).withColumn("formatted", F.lit(1)).withColumn("Loss_Runs", F.lit(2)))
    assert made.columns == ["id", "messages", "a.b", "__f", "turns", "formatted", "loss_runs"] and made.where("id = 2").first()["formatted"] == ""
    parts = spark.createDataFrame([("k", 1, "bot", "b"), ("k", 0, "user", "a")], "conversation_id string, message_index int, role string, content string")
    assert [(r["conv_id"], [tuple(t) for t in r["turns"]]) for r in C.conversations_of(parts).collect()] == [("k", [("user", "a"), ("bot", "b")])]
    pair = spark.createDataFrame([("p", "r", "s")], "prompt string, response string, system string")
    assert [tuple(t) for t in C.conversations_of(pair).first()["turns"]] == [("system", "s"), ("user", "p"), ("assistant", "r")]


def test_rows_by_turn(spark):
    rows = spark.createDataFrame([(1, 2, "assistant", "b", 0), (1, 1, "user", None, 0), (2, None, None, "x", 0), (1, 2, "assistant", "a", 0), (None, 1, "user", "n", 0)], "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in C.conversations_of(rows).collect()}
    assert got == {1: [("user", ""), ("assistant", "a"), ("assistant", "b")], 2: [("", "x")], None: [("user", "n")]}
    assert C.conversations_of(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.conversations_of(rows.drop("turn"))


def test_query_digests(spark, tmp_path):
    turns = [(5, 0, "user", "hé <|im_end|>"), (5, 1, "assistant", "a<|b"), (5, 2, "assistant", "c")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in C.op4_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {5, -1} and got[5]["loss_chars"] == 5 and got[-1]["n_turns"] == 2
    assert got[5]["loss_sha256"] == hashlib.sha256(b"a<|bc").hexdigest()
    assert got[5]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
    plan = C.op4_chat_formatting(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
