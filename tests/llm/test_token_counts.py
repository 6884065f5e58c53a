import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlake.llm import token_counts as C


def brute(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start, True))
            start = i + 1
    return [*out, (start, len(ids) - start, False)] if start < len(ids) else out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([1, 2, 49407]), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 6, 64]))
def test_any_file_in_any_blocks(spark, tmp_path_factory, files, block_bytes):
    at = tmp_path_factory.mktemp("ids")
    for k, ids in enumerate(files):
        np.array(ids, "<u2").tofile(at / f"{k}.ids")
    folder = f"file://{at}"
    got = C.scan_token_files(C.file_sizes(spark, folder), folder, block_bytes=block_bytes, span=3).collect()
    for k, ids in enumerate(files):
        mine = sorted((r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in got if r["file"] == f"{k}.ids")
        assert mine == [(i, *x) for i, x in enumerate(brute(ids, 49407))]


@pytest.mark.parametrize("block_bytes", [16, 1 << 20])
def test_counts_are_the_tokenizers(spark, make, block_bytes):
    w = make(11)
    docs = [(i, w((i * 13) % 50)) for i in range(40)] + [(100, None), (101, ""), (102, "a<|endoftext|>b"), (103, w(3000)), (5, "again")]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = sorted((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in docs)
    rows = spark.createDataFrame([(i, x, "z") for i, x in docs], "doc_id long, text string, file string").repartition(3)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in C.token_counts(rows, block_bytes=block_bytes).collect()) == want
    assert C.token_counts(rows.limit(0)).count() == 0


def test_absent_folder(spark, tmp_path):
    assert C.file_sizes(spark, f"file://{tmp_path}/none").count() == 0
