import random
import zlib

import numpy as np
import pytest

from strandlake.llm import toxicity as X

INSULTS = ["blockhead", "rotter", "gobbin"]


def corpus(make, n=500, seed=12):
    """Invented prose; every fifth document has insults, some of them with endings or letters put in."""
    w, rng, docs = make(seed), random.Random(seed), []
    for i in range(n):
        words = w(rng.randint(30, 120)).split()
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "", "s", "!", ","]))
        docs.append((i, " ".join(words[:20]) + ".\n" + " ".join(words[20:]), int(toxic)))
    return docs


@pytest.fixture(scope="module")
def data(spark, make):
    docs = corpus(make)
    rows = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(None, 1), (3, None)], "doc_id long, toxic int").cache()
    return docs, rows, labels, X.train_on(rows, labels)


def test_held_out_accuracy(spark, data):
    docs, rows, labels, model = data
    score = {r["doc_id"]: r["score"] for r in X.scored(rows, model).collect()}
    out = [(score[i] >= 0.5, bool(y)) for i, _, y in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) > 60 and np.mean([a == b for a, b in out]) > 0.97
    held = {r["doc_id"] for r in rows.where(X.held_out(rows["doc_id"])).collect()}
    assert held == {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}


def test_insults_with_gaps_and_letters_put_in(data, make):
    model, w = data[3], make(77)
    score = X._scorer(model)
    for bad in ("block-head rot-ter", "bl.ockhead rotter", "r o t t e r gobbin", "blockxhead rotterr", "GOBBIN, Rotter!", "b l o c k h e a d and rotters"):
        assert score([f"{w(20)} {bad} {w(20)}. {bad}"])[0] > 0.5, bad
    assert max(score([w(80) for _ in range(30)])) < 0.5


@pytest.mark.parametrize("first,step", [(0x430, 1), (0x4E00, 331)])
def test_other_scripts(spark, make, first, step):
    """The corpus in letters of another script, on which a toxic text is told as it is in Latin ones."""
    script = str.maketrans({chr(97 + i): chr(first + step * i) for i in range(26)})
    docs = [(i, t.translate(script), y) for i, t, y in corpus(make)]
    model = X.train_on(spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int"))
    out = [(i, t, y) for i, t, y in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    got = X._scorer(model)([t for _, t, _ in out]) >= 0.5
    assert np.mean([a == bool(y) for a, (_, _, y) in zip(got, out, strict=True)]) > 0.97


def test_characters_beyond_latin_1_are_folded():
    text = "Straße ÿ x2 — “Дурак”\u3000ВОН… 笨蛋！"
    got = X.low(text)
    assert len(got) == len(text) and got.startswith("straße ÿ x2 ? ?") and X.low(got) == got and got == X.low(text.upper().replace("SS", "ß"))
    assert [len(w) for w in got.split()] == [6, 1, 2, 1, 7, 4, 3] and got.split()[4].strip("?").isalnum() and len(set(X._STANDS)) == 25
    assert len({int(X._code[ord(c)]) for c in X._STANDS}) == 25 and got.split()[6][-1] == "?"


def test_odd_texts_and_rows(spark, data):
    model = data[3]
    texts = [None, "", " ", "x" * 5000, "blockhead" * 500, "日本 blockhead rotter gobbin", "." * 300, "ÿ" * 50, "a b c d e f g"]
    a, b = X._scorer(model)(texts), np.concatenate([X._scorer(model)([t]) for t in texts])
    assert np.allclose(a, b) and ((a >= 0) & (a <= 1)).all() and a[0] == a[1] and a[5] > 0.5
    rows = spark.createDataFrame([(1, "fine words", 5), (2, "you rotter and blockhead, gobbin", 6), (2, "you rotter and blockhead, gobbin", 6), (None, None, 7)], "doc_id long, text string, score int")
    kept = X.without_toxic(rows, model)
    assert kept.columns == rows.columns and sorted(r["score"] for r in kept.collect()) == [5, 7]


def test_no_or_one_sided_labels(spark, data):
    _, rows, labels, _ = data
    for some, want in ((labels.limit(0), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0)):
        assert [r["score"] for r in X.scored(rows.limit(5), X.train_on(rows, some)).collect()] == pytest.approx([want] * 5, abs=1e-9)
    assert X.scored(rows.limit(0), data[3]).count() == 0


def kernel_by_hand(a, b):
    def sub(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + X.SPAN + 1)):
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + X.DECAY ** (k - i - 2)
        return out

    x, y = sub(a), sub(b)
    dot = sum(v * y.get(s, 0) for s, v in x.items())
    return dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel_matches_its_definition():
    words, marks = ["rotter", "rottter", "otter", "roster", "ananan", "blockhead", "ab", "zz"], ["#rotter#", "lockh", "#anan"]
    at, k = X.Kernel(marks)(words)
    want = np.array([[kernel_by_hand(f"#{w}#", m) for m in marks] for w in words])
    want[want < X.LEAST] = 0
    full = np.zeros_like(want)
    full[at] = k
    assert np.allclose(full, want**X.POWER, atol=1e-6)


def test_the_quick_bound_misses_nothing(data, make):
    docs, _, _, model = data
    lexicon = X._lexicon(model)
    for _, t, _ in docs[:60] + [(0, "block.head, 'rotter'! (gobbins) r o t t e r é" + make(5)(40), 0)]:
        lexicon.learn(set(X.words_of(t)))
        (n, found), = X.suspects([X.low(t)], lexicon.kernel)
        assert n == len(X.words_of(t)) and sorted(w for w in found if w in lexicon.bad) == sorted(w for w in X.words_of(t) if w in lexicon.bad)
