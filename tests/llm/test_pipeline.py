"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import toxicity
from strandlake.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import test_decontamination as D
    import test_line_dedup as L
    import test_minhash as M
    import test_packing as K

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontamination", "packing"]
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        was, docs = docs.toPandas(), stage(spark, docs, SF).cache()
        now = docs.toPandas()
        pairs = list(zip(was["doc_id"].tolist(), was["text"].tolist(), strict=True))
        kept[name] = set(now["doc_id"])
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.train_on(table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels"))
            assert kept[name] == {i for (i, _), s in zip(pairs, toxicity._scorer(model)([t for _, t in pairs]), strict=True) if s < 0.5}
        elif name == "line_dedup":
            want = L.brute(pairs)
            assert {i: t or "" for i, t in zip(now["doc_id"], now["text"], strict=True)} == {i: v[2] for i, v in want.items()}
            assert now["n_chars"].tolist() == [len(t) for t in now["text"]]
        elif name == "minhash_dedup":
            assert kept[name] == {i for i, (_, c) in M.brute(pairs).items() if i == c}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
            windows = {b" ".join(w[k : k + 13]) for w in (D.words(x) for _, x in items) for k in range(len(w) - 12)}
            bad = {i for i, t in pairs for w in [D.words(t)] if any(b" ".join(w[k : k + 13]) in windows for k in range(len(w) - 12))}
            assert min(len(D.words(x)) for _, x in items) >= 13 and bad and kept[name] == {i for i, _ in pairs} - bad
        else:
            n = K.valid(docs.collect(), pairs, 4096)
            assert n <= -(-int(np.sum(now["length"])) // 4096) + 2


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
