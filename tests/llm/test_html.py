import tracemalloc

import numpy as np
import pytest

from strandlake.llm import html_extract as H
from strandlake.llm.html_blocks import blocks_of


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <!-- <p>no</p> --><nav><ul><li><a href="/x">Home<li>Two</a></ul></nav><article><p>One  <b>bold<br>text<p>Two&nbsp;&lt;3 a < b</p>tail</article><footer>&copy; x"""
    found = blocks_of(page)
    assert [b.text for b in found] == ["T & t", "Home", "Two", "One bold text", "Two\xa0<3 a < b", "tail", "© x"]
    assert [t for t, _ in found[1].path][-3:] == ["ul", "li", "a"] and found[1].linked == 4
    assert [t for t, _ in found[4].path][-2:] == ["article", "p"] and [t for t, _ in found[6].path][-1] == "footer"


@pytest.mark.parametrize("page", ["<b>" * 50_000 + "x", "<div>" * 50_000 + "y", "<!--" * 50_000, "<p " * 50_000, '<a href="' * 30_000, "< " * 50_000, "<p>x" * 30_000, "</div>" * 50_000 + "z", "<script>" * 1000])
def test_odd_pages_end_soon(page):
    blocks_of(page)


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    model = H.Labeller(rng, inputs=5, hidden=3)
    x, mask = rng.standard_normal((4, 2, 5)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    y = rng.integers(0, 2, (4, 2)).astype(float)

    def loss():
        p = 1 / (1 + np.exp(-model.scores(x, mask)))
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = model.gradient(x, mask, y)
    for k, p in model.p.items():
        for i in range(0, p.size, max(1, p.size // 6)):
            was = p.flat[i]
            p.flat[i] = was + 1e-5
            up = loss()
            p.flat[i] = was - 1e-5
            down = loss()
            p.flat[i] = was
            assert abs((up - down) / 2e-5 - g[k].flat[i]) < 1e-6, k


def test_accuracy_on_pages_that_were_not_seen():
    rng = np.random.default_rng(12345)
    pages = [H.training_page(rng) for _ in range(150)]
    got = H.label([b for b, _ in pages], H.trained())
    assert np.mean(np.concatenate([g == (y > 0) for g, (_, y) in zip(got, pages, strict=True)])) > 0.98


def test_context_counts():
    """Equal blocks are judged by the page around them."""
    text = "<p>Short words here and there, of equal length.</p>"
    page = f'<nav><ul><li><a href="/">A</a></li></ul></nav><article><h1>T</h1>{text * 3}</article><div class="comments">{text * 2}</div><footer>&copy; x</footer>'
    assert H.main_texts([page], H.trained())[0].count("Short words") == 3


def test_parts_of_a_page_give_the_whole_pages_scores():
    rng, model = np.random.default_rng(3), H.trained()
    for _ in range(5):
        blocks, _ = H.training_page(rng)
        if blocks:
            x, mask = H.padded([H.vectors(blocks)])
            whole = model.scores(x, mask)[:, 0]
            for step in (1, 3, 1000):
                assert np.allclose(model.scores_of_page(blocks, step), whole, atol=1e-9)


def test_a_long_page_among_small_ones(monkeypatch):
    """A page of a megabyte of one-letter paragraphs: what is held at once is bounded, and results are those of pages alone."""
    long_ = "<article><h1>T</h1>" + "<p>x" * 250_000 + "</article>"
    small = [f"<nav><a href=/>m{i}</a></nav><article><h1>Title {i}</h1><p>Some words of page {i}.</p></article>" for i in range(63)]
    model, seen = H.trained(), []
    padded, run = H.padded, H.Labeller._run
    monkeypatch.setattr(H, "padded", lambda found: (seen.append(len(found) * max(map(len, found))), padded(found))[1])
    monkeypatch.setattr(H.Labeller, "_run", lambda self, d, x, *a: (seen.append(x.shape[0] * x.shape[1]), run(self, d, x, *a))[1])
    tracemalloc.start()
    got = H.main_texts([*small[:30], long_, *small[30:]], model)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(seen) <= H.CELLS_AT_ONCE and most < 400e6
    assert [x for k, x in enumerate(got) if k != 30] == [H.main_texts([p], model)[0] for p in small] and got[30].count("x") > 100_000


def plain_extract(page, model):
    """A page by itself, padded by nothing: blocks, labels, joined texts."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    x, mask = H.padded([H.vectors(blocks)])
    return "\n\n".join(b.text for b, s in zip(blocks, model.scores(x, mask)[:, 0], strict=True) if s > 0)


def test_query_against_pages_one_by_one(spark):
    """The query over the whole smallest table; main text is told there by its element, which training does not rely on."""
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in H.op6_html_extraction(spark, sf).collect()}
    assert got.keys() == pages.keys() and all(got[i]["url"] == p["url"] and got[i]["n_chars"] == len(got[i]["text"]) for i, p in pages.items())
    assert {i: r["text"] for i, r in got.items()} == {i: plain_extract(p["html"], H.trained()) for i, p in pages.items()}
    found = [(b, k) for p in pages.values() for blocks in [blocks_of(p["html"])] for b, k in zip(blocks, H.label([blocks], H.trained())[0], strict=True)]
    assert len(found) > 800 and np.mean([k == ("article" in {t for t, _ in b.path}) for b, k in found]) > 0.99


def test_a_column_that_is_called_text(spark):
    rows = spark.createDataFrame([(1, "<article><h1>A title</h1><p>Words of it.</p></article>", "old", 5)], "id long, html string, Text string, `a.b` long")
    got = H.extract(rows)
    assert got.columns == ["id", "a.b", "text"] and got.first()["text"] == "A title\n\nWords of it."
    assert H.extract(rows.select("html")).columns == ["text"] and H.extract(rows, into="main").columns == ["id", "Text", "a.b", "main"]


def test_rows(spark):
    pages = [(1, "u", None, "a"), (2, None, "", "b"), (3, "u", '<nav><a href="/">Menu</a></nav><article><h1>Title</h1><p>First  &amp;\nlast.</p></article><footer>&copy; me</footer>', "c"), (3, "u", "<br>", "d")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string, `__row` string")
    got = sorted((r["__row"], r["text"]) for r in H.extract(rows).collect())
    assert got == [("a", ""), ("b", ""), ("c", "Title\n\nFirst & last."), ("d", "")]
    assert H.extract(rows.limit(0)).count() == 0
