import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_runs_without_the_training_data_package():
    code = "import sys; sys.modules['strandlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 50 and out[1] == "False" and int(out[2]) > 50


def test_nothing_else_imports_it():
    found = subprocess.run(["grep", "-rlE", r"strandlake\.llm|from strandlake import llm|import corpus_pipeline", "--include=*.py", f"{ROOT}/strandlake", f"{ROOT}/bench.py"], capture_output=True, text=True).stdout.split()
    assert all("/strandlake/llm/" in f for f in found)


def test_a_dependency_that_is_missing_inside_is_an_error():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert not os.path.isdir(f"{ROOT}/strandlake/llm") or (out.returncode != 0 and "ahocorasick" in out.stderr)
