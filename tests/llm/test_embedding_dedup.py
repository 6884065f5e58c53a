import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandlake.llm import embedding_dedup as E


def brute(rows, least=0.93):
    top, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    groups = defaultdict(list)
    for k, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            groups[label, len(v)].append(k)
    for at in groups.values():
        x = np.array([rows[k][1] for k in at], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hit = x @ x.T >= least
        np.fill_diagonal(hit, False)
        for a, k in enumerate(at):
            links[k] = int(hit[a].sum())
            for b in np.flatnonzero(hit[a]):
                i, j = find(k), find(at[b])
                top[max(i, j)] = min(i, j)
    return {rows[k][0]: (links[k], rows[find(k)][0]) for k in range(len(rows))}


@pytest.mark.parametrize("window,block", [(64, 512), (4, 8)])
def test_against_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng, rows = np.random.default_rng(1), []
    for i in range(400):
        if i % 5 == 0:
            base = rng.standard_normal(8)
        rows.append((i, [float(x) for x in base + rng.standard_normal(8) * rng.choice([0, 0.05, 0.2, 0.35])], i // 100))
    dense = rng.standard_normal(8)
    rows += [(1000 + i, [float(x) for x in dense + rng.standard_normal(8) * 0.2], 1) for i in range(150)]
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, rows[0][1], None), (504, [], 1), (505, [1.0, None], 1), (506, rows[0][1], 0), (507, rows[0][1][:4], 0), (508, [2 * x for x in rows[0][1]], 0), (509, [1e200 * x for x in rows[0][1]], 0)]
    data = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], "vec_id long, embedding array<double>, label int, cls string, comp int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(data, window=window).collect()}
    want = brute(rows)
    total = sum(n for n, _ in want.values())
    assert got.keys() == want.keys()
    if window == 64:
        assert got == want
    else:  # the number of passes grows as windows shrink, so that recall holds
        assert all(got[i][0] <= want[i][0] for i in got) and sum(n for n, _ in got.values()) >= 0.98 * total


def test_empty_and_constants(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.near_duplicates(none).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 3) for i in range(30)], "vec_id long, embedding array<float>, label int")
    assert {(r["n_links"], r["component_id"]) for r in E.near_duplicates(same).collect()} == {(29, 0)}


def test_passes_grow_with_the_logarithm():
    a, b = E.passes_for(10_000), E.passes_for(100_000_000)
    assert 2 <= E.passes_for(10) <= a < b < 20 * a


def test_spanning_links():
    ids = np.arange(10) * 10
    a, b = E.joining(ids, iter([np.array([0, 1, 4]), np.array([0, 2, 4]), np.array([3])]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 10), (10, 20), (40, 50), (20, 40), (40, 60), (30, 60)]


@pytest.mark.parametrize("n,cosine,least", [(6000, 0.7, 0.99), (3000, 0.85, 1.0)])
def test_a_large_label_that_shares_a_direction(spark, n, cosine, least):
    """Isolated pairs just above the threshold, met by more passes or, in the second label, by comparing all pairs."""
    rng, dim = np.random.default_rng(3), 64
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(math.sqrt(cosine) * unit(rng.standard_normal((1, dim))) + math.sqrt(1 - cosine) * unit(rng.standard_normal((n, dim))))
    mean = unit(x.mean(axis=0, keepdims=True))[0]
    for i in range(0, 800, 2):  # the other of a pair is turned away from neither the pair nor the mean
        d = np.linalg.qr(np.stack([x[i], mean, rng.standard_normal(dim)], axis=1))[0]
        x[i + 1] = 0.931 * x[i] + math.sqrt(1 - 0.931**2) * (d[:, 2] * 0.95 + d[:, 1] * np.sign(d[:, 1] @ mean) * math.sqrt(1 - 0.95**2))
    assert (E.passes_of(x[: n // 10], n) == 0) == (least == 1.0)
    rows = [(i, v, 5) for i, v in enumerate(x.tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    hit = x @ x.T >= 0.93
    want = hit.sum(axis=1) - 1
    assert sum(got[i][0] for i in range(n)) >= least * want.sum() >= 800 * least and all(got[i][0] <= want[i] for i in range(n))


def test_passes_grow_as_a_label_concentrates():
    rng = np.random.default_rng(4)

    def passes(cosine, n):
        x = math.sqrt(cosine) * np.eye(64)[0] + math.sqrt(1 - cosine) * rng.standard_normal((256, 64)) / 8
        return E.passes_of(x / np.linalg.norm(x, axis=1, keepdims=True), n)

    assert E.passes_for(100_000) <= passes(0.0, 100_000) < passes(0.5, 100_000) < passes(0.8, 100_000) and passes(0.9, 3000) == 0


def test_spanning_links_of_a_matrix():
    hit = np.zeros((7, 7), bool)
    for i, j in [(0, 2), (2, 4), (0, 4), (5, 6)]:
        hit[i, j] = hit[j, i] = True
    a, b = E.spanning(hit)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 2), (0, 4), (5, 6)]


def planted(n, seed=6, dim=64):
    """n random unit vectors over four labels, of which every twentieth has a near copy of cosine 0.93 to 0.95, and a group of 40."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((n, dim)))
    for i in range(0, n, 20):
        c = rng.uniform(0.9301, 0.95)
        other = rng.standard_normal(dim)
        other = unit(other - (other @ x[i]) * x[i])
        x[i + 4] = c * x[i] + math.sqrt(1 - c * c) * other
    x[41 : 41 + 160 : 4] = unit(x[41] + 0.02 * rng.standard_normal((40, dim)))
    return x, np.arange(n) % 4


def test_recall_of_planted_links_at_50000_vectors(spark, tmp_path):
    """Against all pairs within labels, by brute force in blocks. The measured share is in the README."""
    n = 50_000
    x, label = planted(n)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x), "label": label}), tmp_path / "v.parquet", row_group_size=5000)
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(spark.read.parquet(str(tmp_path / "v.parquet")).repartition(8)).collect()}
    want = np.zeros(n, int)
    for k in range(4):
        at = np.flatnonzero(label == k)
        for lo in range(0, len(at), 2000):
            want[at[lo : lo + 2000]] = (x[at[lo : lo + 2000]] @ x[at].T >= 0.93).sum(axis=1) - 1
    have = np.array([got[i] for i in range(n)])
    recall = have.sum() / want.sum()
    print(f"recall {recall:.5f} of {want.sum()} links")
    assert want.sum() > 2 * 2400 and (have <= want).all() and recall >= 0.99


def test_long_vectors_take_no_longer_than_their_length(spark):
    """Normalising is linear in the length of a vector."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 768))
    x[100:] = x[:200] + 0.01 * rng.standard_normal((200, 768))
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute(rows)


def test_links_of_a_crowd_that_a_sample_misses(spark):
    """1,200 of 12,000 vectors stand near each other without linking, but for 600 pairs; none is among 256 or so told by their ids."""
    rng, n, m, dim = np.random.default_rng(8), 12_000, 1200, 64
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((n, dim)))
    axis = unit(rng.standard_normal(dim))
    x[:m] = unit(math.sqrt(0.88) * axis + math.sqrt(0.12) * unit(rng.standard_normal((m, dim))))
    for i in range(0, m, 2):
        d = np.linalg.qr(np.stack([x[i], axis, rng.standard_normal(dim)], axis=1))[0]
        x[i + 1] = 0.931 * x[i] + math.sqrt(1 - 0.931**2) * (d[:, 2] * 0.95 + d[:, 1] * np.sign(d[:, 1] @ axis) * math.sqrt(1 - 0.95**2))
    told = {r["id"] for r in spark.range(n).where(f"pmod(xxhash64(id, 20240117), {math.ceil(n / 256)}) = 0").collect()}
    ids = [i for i in range(n) if i not in told] + sorted(told)
    rows = [(i, v, 5) for i, v in zip(ids, x.tolist(), strict=True)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    want = brute(sorted(rows))
    assert sum(k for k, _ in want.values()) >= m
    assert sum(k for k, _ in got.values()) == sum(k for k, _ in want.values()) and got == want


@pytest.mark.parametrize("m", [1, 300, 700])
def test_least_links_join_what_all_links_join(monkeypatch, m):
    """Of two blocks, or within one where m is all of its rows, in tiles."""
    monkeypatch.setattr(E, "TILE", 64)
    rng = np.random.default_rng(9)
    for noise in (0.05, 0.25, 0.35, 0.45):
        x = rng.standard_normal((30, 16))[rng.integers(0, 30, 700)] + noise * rng.standard_normal((700, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hit = x @ x.T >= 0.93
        np.fill_diagonal(hit, False)
        if m < 700:
            hit[:m, :m] = hit[m:, m:] = False
        a, b = E.least_links(x, m, 0.93)
        least = np.zeros_like(hit)
        least[a, b] = least[b, a] = True
        assert not (least & ~hit).any()
        i, j = E.spanning(hit)
        k, l = E.spanning(least)  # noqa: E741
        assert len(a) == len(k) == len(i) and set(np.concatenate([i, j]).tolist()) == set(np.concatenate([k, l]).tolist())


def test_blocks_of_a_label_and_passes_on_request(spark, monkeypatch):
    """Labels of one, several and many blocks, with links within and across them; passes where a recall below 1 is asked for."""
    monkeypatch.setattr(E, "PAIRS_BLOCK", 100)
    monkeypatch.setattr(E, "BLOCK_BYTES", 16 * 8 * 100)
    rng, rows = np.random.default_rng(10), []
    for label, n in [(0, 90), (1, 350), (2, 1500)]:
        x = rng.standard_normal((n, 16))
        x[::3] = x[1::3][: len(x[::3])] + 0.3 * rng.standard_normal((len(x[::3]), 16))
        rows += [(len(rows) + k, v, label) for k, v in enumerate(x.tolist())]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    want = brute(rows)
    assert {r["blocks"] for r in E.whole_groups(E.classes_of(data)[1]).collect()} == {4, 15}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(data).collect()} == want
    some = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(data, window=16, recall=0.999).collect()}
    assert all(some[i] <= want[i][0] for i in want) and sum(some.values()) >= 0.98 * sum(n for n, _ in want.values()) > 0
