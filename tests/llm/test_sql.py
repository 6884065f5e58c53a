"""The operators that SQL can express against their SQL: on the smallest tables, and on made ones with awkward rows."""

import duckdb
import numpy as np
import pytest

from strandlake import llm

SF = "/root/testdata/sf0.001"


def same(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'' if sf_dir == SF else '/*.parquet'}')")
    got, want = llm.queries()[name](spark, sf_dir), con.sql(llm.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    found = [sorted((tuple(r) for r in rows), key=repr) for rows in (got.select(*columns).collect(), want.select(*columns).fetchall())]
    assert found[0] == found[1]
    return got.count()


@pytest.fixture(scope="module")
def made(spark, make, tmp_path_factory):
    at, w, rng = str(tmp_path_factory.mktemp("made")), make(8), np.random.default_rng(8)
    base, line = w(120).split(), w(12)
    docs = [(i, " ".join([*base[: 3 * i], w(1), *base[3 * i + 1 :]]) + f"\n {line.upper() if i % 2 else line}\t") for i in range(30)]
    docs += [(100, None), (101, ""), (102, "One  TWO"), (103, "one\x0btwo"), (104, "\n\n"), (105, " ".join(base)), (106, " ".join(base))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    items = [(2, " ".join(base[10:30])), (10, " ".join(base[60:80])), (3, "one two"), (4, None), (5, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    turns = [(1, 0, "system", "<|im_start|>"), (1, 1, "user", None), (1, 2, "assistant", "a\nb"), (2, 0, "user", "é\U0001f600"), (2, 1, "assistant", "<|im_end|>")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    middle = rng.standard_normal((5, 16))
    vectors = [(i, (middle[i % 5] + 0.15 * rng.standard_normal(16)).tolist(), i % 2) for i in range(60)]
    vectors += [(90, None, 0), (91, [0.0] * 16, 0), (92, [float("nan")] * 16, 0), (93, vectors[0][1], None), (94, vectors[0][1], 0), (95, [], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_on_given_tables(spark, name):
    assert same(spark, SF, name) > 0


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_on_made_tables(spark, made, name):
    assert same(spark, made, name) > 0
