import random

import pytest

from strandlake.llm import minhash as M
from strandlake.llm.components import connected_components


def sets(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, percent=M.PERCENT):
    s, top = {i: sets(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def corpus(make, seed=4):
    w, rng, docs = make(seed), random.Random(seed), []
    for g in range(12):
        base = w(rng.choice([3, 8, 60, 150])).split()
        for k in range(rng.choice([1, 2, 9])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 60)) if k else 0):
                words[rng.randrange(len(words))] = w(1)
            docs.append((g * 20 + k, " ".join(words)))
    long_ = w(6000).split()
    docs += [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "One  TWO"), (905, " ".join(long_)), (906, " ".join([*long_[:3000], "new", *long_[3000:]]))]
    return docs


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, make, percent):
    docs = corpus(make)
    got = M.near_duplicates(spark.createDataFrame(docs, "id long, text string").repartition(3), percent).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, percent)


def test_the_threshold_is_four_fifths(spark, make):
    """One word changed in the middle of n costs five shingles: at 0.8 and not below links, and the query's contract links at 0.85."""
    w = make(31)
    docs = []
    for k, n in enumerate((48, 49, 65, 66, 67, 200)):
        words = w(n).split()
        docs += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words[: n // 2], w(1) + "x", *words[n // 2 + 1 :]]))]
    rows = spark.createDataFrame(docs, "id long, text string")
    assert M.PERCENT == 80 and M.OP3_PERCENT == 85
    found = [sum(r["component_id"] != r["id"] for r in M.near_duplicates(rows, p).collect()) for p in (80, 85)]
    assert found == [sum(i != c for i, (_, c) in brute(docs, p).items()) for p in (80, 85)] and found[0] > found[1] > 0


def test_rows_that_share_a_doc_id(spark, make):
    """They are one document: what any of them is like is linked with all."""
    w = make(32)
    a, b, c = w(80), w(80), w(80)
    rows = [(1, a), (1, b), (3, b + " more"), (5, a + " more"), (7, c), (9, c), (9, b), (9, b), (11, None), (11, c + " x"), (13, w(80))]
    got = M.near_duplicates(spark.createDataFrame(rows, "id long, text string")).collect()
    assert sorted((r["id"], r["component_id"]) for r in got) == sorted((i, 13 if i == 13 else 1) for i, _ in rows)
    kept = M.near_dedup(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, `a.b` string"))
    assert {r["doc_id"] for r in kept.collect()} == {1, 13} and kept.columns == ["doc_id", "text", "a.b"]


@pytest.mark.parametrize("most_bits", [1 << 29, 1 << 16, 64])  # the last is too few to be of use
def test_a_large_group_and_blocks(spark, make, monkeypatch, most_bits):
    """Near copies of one text, most of which link through others only; blocks are smaller than the group."""
    monkeypatch.setattr(M, "BITS_BLOCK", 16)
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "BROADCAST_IDS", 0)
    monkeypatch.setattr(M, "MOST_BITS", most_bits)
    w, rng = make(5), random.Random(5)
    base, docs = w(120).split(), []
    for i in range(70):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
            words[k] = w(1)
        docs.append((i, " ".join(words)))
    got = M.near_duplicates(spark.createDataFrame(docs, "id long, text string")).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs)


def test_the_documents_that_stay(spark, make):
    docs = corpus(make, 6)
    want = {i for i, (_, c) in brute(docs).items() if i == c}
    rows = spark.createDataFrame([(i, t, "x", i) for i, t in docs] + [(None, "lost", "x", 0)], "doc_id long, text string, rep string, id long")
    kept = M.near_dedup(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(want) and kept.where("doc_id IS NULL").count() == 1
    assert M.near_dedup(rows.limit(0)).count() == 0


def test_estimate_bounds():
    assert M.most_mismatches() < M.MINIMA and M.most_mismatches(minima_=M.WIDE) / M.WIDE < M.most_mismatches() / M.MINIMA


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100], got[150], got[200]} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
