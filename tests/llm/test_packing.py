import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import packing as K
from strandlake.llm.token_ids import CHARS_AT_ONCE, PartTokenizer

PATH = P.path("word_bpe_49k.json")
ODD = ["", "Don't STOP, it's 3.14!!  ok", "naïve Ünï © ½ 42²", "日本語 text", "a<|endoftext|>b", "x" * 300, "\x00\x01 a\u2028b", "İstanbul ǅ ﬁ", "we're I'LL 'tis 'S", "tab\tnew\nline\x85nbsp\xa0z", "___--__ #$%", "it's' 's's", "a\x1cb\x1d c\x1e\x1f", "\x1f", "  lead and trail \n\x85", "x,y.z 'll've don't--it's 12ab34"]


def plain(text):
    return TOKENIZER_.encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers_own():
    t = PartTokenizer(PATH)
    for text, ids in zip(ODD, t.encode_all(ODD), strict=True):
        assert ids.tolist() == plain(text), text
    long_ = ("word and number 123 " * (CHARS_AT_ONCE // 19 + 50)).strip()
    assert t.encode(long_).tolist() == plain(long_)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert PartTokenizer_.encode(text).tolist() == TOKENIZER_.encode(text, add_special_tokens=False).ids


PartTokenizer_, TOKENIZER_ = PartTokenizer(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_bounds_and_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    place, offset = K.best_fit(lengths, 100)
    fill = defaultdict(list)
    for n, p, o in zip(lengths, place, offset, strict=True):
        fill[int(p)].append((int(o), n))
    for x in fill.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 100
    assert max(1, -(-sum(lengths) // 100)) <= K.lower_bound(np.array(lengths), 100) <= len(fill)


def test_bound_sees_halves():
    assert K.lower_bound(np.array([51] * 7), 100) == 7 and K.lower_bound(np.array([34] * 6), 100) == 3 and K.lower_bound(np.array([], int), 100) == 0


def valid(rows, docs, capacity):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in docs:
        ids = np.array([*plain(text or ""), 1], "<u4")
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == [(k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    for x in sequences.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return len(sequences)


def test_pieces_and_sequences(spark, make):
    w = make(9)
    docs = [(i, w((i * 37) % 90)) for i in range(80)] + [(200, None), (201, ""), (202, w(900)), (203, "<|endoftext|> é日")]
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, piece int, uid string")
    got = K.pack(rows, capacity=128).collect()
    n = valid(got, docs, 128)
    lengths = np.array([r["length"] for r in got])
    assert n <= K.lower_bound(lengths, 128) + 3
    assert K.pack(rows.limit(0)).count() == 0
    assert K.pack(rows.limit(3).union(rows.limit(3)), capacity=128).count() == 2 * K.pack(rows.limit(3), capacity=128).count()


def test_exchanges_only_help(spark):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(i, i, 0, int(n)) for i, n in enumerate(rng.integers(20, 70, 600))], "uid long, doc_id long, piece int, length long")
    used = {k: K.place(items, 100, per_partition=40, exchanges=k).select("sequence_id").distinct().count() for k in (0, 3)}
    assert used[3] <= used[0]
    whole = K.place(items, 100, per_partition=40).join(items, "uid").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"), F.count("*")).collect()
    assert all(r["n"] == r["m"] <= 100 for r in whole) and sum(r["count(1)"] for r in whole) == 600
