import hashlib
import random
import re

from strandlake.llm import decontamination as D


def words(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(docs, items):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k, t in items:
            b = words(t)
            n = min(13, len(b))
            for p in range(len(b) - n + 1) if n else ():
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == b[p : p + n]:
                        hit |= set(range(q, q + n))
                        found.add(k)
        out[i] = (len(w), len(hit), sorted(found), 0 < len(hit) and 20 * len(hit) >= len(w))
    return out


def data(make):
    w, rng = make(8), random.Random(8)
    items = [(k, w(rng.choice([1, 2, 5, 13, 14, 40]))) for k in range(12)] + [(50, None), (51, " .. "), (52, "Über-Maß, x2!"), (None, w(20))]
    docs = []
    for i in range(30):
        text = w(rng.choice([0, 3, 30, 200]))
        if i % 3 == 0:
            t = rng.choice([t for _, t in items if t])
            text = f"{text} {t.upper() if i % 2 else t.replace(' ', ' -- ')}, {text}"
        docs.append((i, text))
    return [*docs, (90, None), (91, ""), (92, "!!"), (93, "ÜBER maß X2"), (94, "über; maß  x2 " + w(60)), (95, items[0][1] * 1 + " " + items[0][1])], items


def run(spark, docs, items):
    got = D.contaminated_words(spark.createDataFrame(docs, "__row long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {r["__row"]: (r["n_words"], r["n_hit"], list(r["items"]), 0 < r["n_hit"] and 20 * r["n_hit"] >= r["n_words"]) for r in got.collect()}


def test_against_brute_force(spark, make, monkeypatch):
    docs, items = data(make)
    want = brute(docs, [x for x in items if x[0] is not None])
    assert run(spark, docs, items) == want and sum(v[3] for v in want.values()) > 3
    monkeypatch.setattr(D, "PART_CHARS", 150)  # several automata
    assert run(spark, docs, items) == want


def test_rows_that_share_a_doc_id_or_have_none(spark, make, monkeypatch):
    docs, items = data(make)
    ids = [i % 5 or None for i in range(len(docs))]
    want = brute([(k, t) for k, (_, t) in enumerate(docs)], [x for x in items if x[0] is not None])
    want = sorted((i or 0, *want[k]) for k, i in enumerate(ids))
    rows = spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, docs, strict=True)], "__row long, text string")
    for chars in (D.PART_CHARS, 150):  # one automaton and several
        monkeypatch.setattr(D, "PART_CHARS", chars)
        got = D.contaminated_words(rows, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted((r["__row"] or 0, r["n_words"], r["n_hit"], list(r["items"]), 0 < r["n_hit"] and 20 * r["n_hit"] >= r["n_words"]) for r in got) == want


def bad(docs, items):
    """Documents with 13 words of an item in a row, and those of which shorter items are a twentieth."""
    items = [x for x in items if x[0] is not None]
    long_ = [x for x in items if len(words(x[1])) >= 13]
    return {i for i, v in brute(docs, long_).items() if v[1]} | {i for i, v in brute(docs, items).items() if v[3]}


def test_documents_that_stay(spark, make, monkeypatch):
    docs, items = data(make)
    long_item = next(t for k, t in items if len(words(t)) == 40)
    w = make(21)
    docs += [(200, f"{w(2000)} {long_item} {w(2000)}"), (201, f"{w(900)} {' '.join(long_item.split()[:12])} {w(900)}"), (202, " ".join(long_item.split()[5:18])), (203, f"{w(400)} über maß x2 {w(400)}")]
    gone = bad(docs, items)
    assert {200, 202} <= gone and not {201, 203} & gone
    rows = spark.createDataFrame([(i, t, 1, "k", i) for i, t in docs], "doc_id long, text string, items long, __row string, `a.b` long")
    for chars in (D.PART_CHARS, 150):
        monkeypatch.setattr(D, "PART_CHARS", chars)
        kept = D.decontaminate(rows, spark.createDataFrame(items, "item_id long, text string"))
        assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - gone
        assert {r["__row"] for r in kept.collect()} == {"k"}
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(rows, none).count() == len(docs) and D.decontaminate(rows.limit(0), none).count() == 0


def test_an_item_larger_than_a_part(spark, make, monkeypatch):
    """Long items are cut into runs of words that overlap, so that all their windows are there, and no part is much larger than meant."""
    w = make(22)
    items, docs = [(1, w(400)), (2, w(300))], []
    for i in range(60):
        t = items[i % 2][1].split()
        docs.append((i, f"{w(5)} {' '.join(t[i * 4 : i * 4 + 13 + i % 3])} {w(5)}"))
    want = brute(docs, items)
    for name, value in (("PART_CHARS", 300), ("SEGMENT_CHARS", 100), ("SEGMENT_WORDS", 20)):
        monkeypatch.setattr(D, name, value)
    given = spark.createDataFrame(items, "item_id long, text string")
    parts = D._parts(given)
    assert len(parts) > 10 and max(sum(len(r["text"]) for r in p.collect()) for p in parts) < 4 * 300
    assert run(spark, docs, items) == want and all(v[1] >= 13 for v in want.values())


def test_offsets_are_of_the_original_text():
    auto = D.automaton(D.item_windows([(1, b"alpha beta gamma")]))
    text = "So: ALPHA, béta? alpha -- Beta\tgamma!".encode()
    n, mask, whole, items, same = D.scan(text, auto)
    assert n == 6 and items == {1} and len(same) == len(text) and not whole.any()
    assert [text[a:b] for a, b in D.spans(mask, same)] == [b"alpha -- Beta\tgamma"]


def test_query(spark, make, tmp_path):
    docs, items = data(make)
    items = [x for x in items if x[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {i: (n, h, len(k), hashlib.sha256(",".join(sorted(map(str, k))).encode()).hexdigest(), c) for i, (n, h, k, c) in brute(docs, items).items()}
    assert {r[0]: tuple(r)[1:] for r in D.op5_decontamination(spark, str(tmp_path)).collect()} == want
