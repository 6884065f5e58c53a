"""HTML extraction by a recurrent block labeller.

A page is read as its sequence of blocks. Each has a vector of its tag path (hashed element and class names, by distance from
the text), of its hashed words, and of a few measures. A bidirectional LSTM, in numpy, reads the whole sequence both ways, so
that every block is judged with the page around it; blocks that are more likely main text than not are kept, in page order.

The machine is trained here, once for each process, on pages that a seeded grammar writes: layouts of many kinds whose parts
are known. Names of parts are often left out or meaningless there, so that order, lengths, links and words count too. Nothing of
the tables is used for training. TRAIN_PAGES bounds the sample.

Defined cases: null or empty html, or a page without main text, gives the empty string; blocks are cut as html_blocks says;
white space is ``[\\x20\\x09-\\x0D]``; pages of any length are read whole, with bounded inputs at a time; repeated rows are extracted
each; a given column ``text`` gives way to the extracted one, other columns pass through whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import in_turn, table
from strandlake.llm.html_blocks import BREAKING, Block, Path, blocks_of

PATH_DIMS, WORD_DIMS, MEASURES = 160, 32, 8
INPUTS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 20
TRAIN_PAGES, EPOCHS, BATCH, RATE, SEED = 900, 8, 30, 0.01, 7
MOST_CACHED = 200_000
#: Pages that are taken apart together, and characters of them.
PAGES_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 21
#: Blocks that are inputs of the machine at once, with those that pad shorter pages: 1,600 bytes each, and as many again for states.
CELLS_AT_ONCE = 8192

_TOKEN = re.compile(r"[a-z]+")
_paths: dict[Path, np.ndarray] = {}
_words: dict[str, tuple[int, float]] = {}


def _bucket(name: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    return h % dims, 1.0 if h & 0x10000 else -1.0


def path_vector(path: Path) -> np.ndarray:
    found = _paths.get(path)
    if found is None:
        if len(_paths) >= MOST_CACHED:
            _paths.clear()
        found = np.zeros(PATH_DIMS)
        # elements that only change letters tell nothing, unless they are named
        for k, (tag, named) in enumerate(x for x in reversed(path) if x[0] in BREAKING or x[0] == "a" or x[1]):
            near = "leaf" if k < 2 else "above"
            for name in (f"{near}:{tag}", f"any:{tag}", *(f"class:{x}" for x in dict.fromkeys(_TOKEN.findall(named)))):
                i, sign = _bucket(name, PATH_DIMS)
                found[i] += sign * (1.0 if k < 3 else 0.7)
        _paths[path] = found
    return found


def vectors(blocks: list[Block], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Inputs of a page's blocks, or of those from lo up to hi."""
    some = blocks[lo:hi]
    out = np.zeros((len(some), INPUTS))
    for i, b in enumerate(some):
        words = b.text.lower().split()
        v = out[i]
        v[:PATH_DIMS] = path_vector(b.path)
        if len(_words) >= MOST_CACHED:
            _words.clear()
        hashed = [_words[w] if w in _words else _words.setdefault(w, _bucket(w, WORD_DIMS)) for w in words]
        sums = np.bincount([h[0] for h in hashed], [h[1] for h in hashed], minlength=WORD_DIMS) if hashed else np.zeros(WORD_DIMS)
        v[PATH_DIMS : PATH_DIMS + WORD_DIMS] = sums / (1 + np.linalg.norm(sums))
        n = len(b.text)
        v[-MEASURES:] = (np.log1p(n) / 6, np.log1p(len(words)) / 4, b.linked / max(1, n), b.text[-1] in ".!?:;…\"”", "©" in b.text or "|" in b.text, (lo + i) / len(blocks), 1.0 if lo + i == 0 else 0.0, min(1.0, len(b.path) / 12))
    return out


class Labeller:
    """Bidirectional LSTM over padded sequences, with a logistic unit on both directions' states."""

    def __init__(self, rng: np.random.Generator, inputs: int = INPUTS, hidden: int = HIDDEN) -> None:
        self.h = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.standard_normal((inputs, 4 * hidden)) * inputs**-0.5
            self.p["h" + d] = rng.standard_normal((hidden, 4 * hidden)) * hidden**-0.5
            self.p["c" + d] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
        self.p["out"] = rng.standard_normal(2 * hidden) * 0.1
        self.p["bias"] = np.zeros(1)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """States, what the gradient needs, and the last state and cell, from which more may go on. x of (time, page, input); where mask is 0 states pass by unchanged."""
        n, h = x.shape[1], self.h
        gates = x @ self.p["x" + d] + self.p["c" + d]
        state, cell = start or (np.zeros((n, h)), np.zeros((n, h)))
        states, kept = np.zeros((len(x), n, h)), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = gates[t] + state @ self.p["h" + d]
            i, f, o = (1 / (1 + np.exp(-np.clip(a[:, k * h : (k + 1) * h], -30, 30))) for k in range(3))
            g, m = np.tanh(a[:, 3 * h :]), mask[t][:, None]
            new = f * cell + i * g
            out = np.tanh(new)
            if keep:
                kept.append((t, i, f, o, g, cell, out, state, m))
            cell, state = np.where(m, new, cell), np.where(m, o * out, state)
            states[t] = state
        return states, kept, (state, cell)

    def scores_of_page(self, blocks: list[Block], step: int) -> np.ndarray:
        """Scores of one page's blocks, of which so many are inputs at a time: each direction goes over the page with its state carried on."""
        out, h = np.full(len(blocks), self.p["bias"][0]), self.h
        for k, d in enumerate("fb"):
            starts, carried = range(0, len(blocks), step), None
            for lo in starts if d == "f" else reversed(starts):
                x = vectors(blocks, lo, lo + step)[:, None]
                states, _, carried = self._run(d, x, np.ones(x.shape[:2], bool), False, carried)
                out[lo : lo + step] += states[:, 0] @ self.p["out"][k * h : (k + 1) * h]
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(d, x, mask, False)[0] for d in "fb"], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over blocks."""
        runs, h = {d: self._run(d, x, mask, True) for d in "fb"}, self.h
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        prob = 1 / (1 + np.exp(-np.clip(both @ self.p["out"] + self.p["bias"], -30, 30)))
        wrong = (prob - y) * mask / mask.sum()
        g = {"out": np.einsum("tn,tnk->k", wrong, both), "bias": np.array([wrong.sum()])}
        for k, d in enumerate("fb"):
            up = wrong[:, :, None] * self.p["out"][k * h : (k + 1) * h]
            ds, dc = np.zeros(up.shape[1:]), np.zeros(up.shape[1:])
            da, gh = np.zeros((*x.shape[:2], 4 * h)), np.zeros((h, 4 * h))
            for t, i, f, o, c, cell, out, state, m in reversed(runs[d][1]):
                ds = ds + up[t]
                dn = np.where(m, dc + ds * o * (1 - out**2), 0)
                a = np.concatenate([dn * c * i * (1 - i), dn * cell * f * (1 - f), np.where(m, ds * out, 0) * o * (1 - o), dn * i * (1 - c**2)], axis=1)
                da[t] = a
                gh += state.T @ a
                ds, dc = np.where(m, 0, ds) + a @ self.p["h" + d].T, np.where(m, dn * f, dc)
            g["x" + d], g["h" + d], g["c" + d] = np.einsum("tni,tnk->ik", x, da, optimize=True), gh, da.sum(axis=(0, 1))
        return g


def padded(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, found))
    x, mask = np.zeros((most, len(found), INPUTS)), np.zeros((most, len(found)), bool)
    for i, v in enumerate(found):
        x[: len(v), i] = v
        mask[: len(v), i] = True
    return x, mask


# A grammar of pages: fixed names that pages give their parts, for training.
_MAIN = "article main content post entry story body text page-content article-body post-content entry-content story-body".split()
_OTHER = {
    "menu": "nav menu navigation navbar topnav breadcrumbs tabs main-menu sitemap".split(),
    "head": "header masthead banner site-header topbar branding logo".split(),
    "foot": "footer site-footer colophon copyright bottom legal page-footer".split(),
    "side": "sidebar aside widget related rail secondary recommended popular".split(),
    "note": "notice cookie consent alert popup modal disclaimer newsletter subscribe".split(),
    "advert": "ad ads advert sponsor promo banner-ad sponsored adslot".split(),
    "form": "form search login signup contact search-form".split(),
    "reply": "comments comment replies discussion disqus respond comment-list".split(),
    "share": "share social tools meta byline tags sharing".split(),
}
_SYLLABLES = "an ber ch da el en er fo ga hi in ka la lo mi na no or pa ra re sa st ta th ti tion un ver wo".split()


class _Grammar:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng

    def pick(self, names: list[str]) -> str:
        return names[int(self.rng.integers(len(names)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int, stop: str = "") -> str:
        n = int(self.rng.integers(low, high + 1))
        return " ".join("".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)).capitalize() + stop

    def prose(self) -> str:
        low, high = ((1, 4), (5, 25), (25, 90))[int(self.rng.choice(3, p=(0.25, 0.35, 0.4)))]
        text = self.words(low, high, self.pick([".", ".", ".", "!", "?", ""]))
        if self.chance(0.15):
            text = text.replace(" ", " | ")
        if self.chance(0.2):
            text = f"<b>{text}" + ("</b>" if self.chance(0.5) else "<br>")
        return text + (f' <a href="/x">{self.words(1, 3)}</a>' if self.chance(0.2) else "")

    def open(self, tag: str, named: str) -> str:
        how = self.rng.random()
        return f"<{tag}>" if not named or how < 0.1 else f'<{tag} {"class" if how < 0.7 else "id"}="{named}">'

    def links(self, n: int) -> str:
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else " ".join(items)

    def main(self) -> str:
        """Blocks of main text, each with the mark of its label."""
        out = [f"<h1>\x01{self.words(2, 12)}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.75:
                out.append(f"<p>\x01{self.prose()}" + ("</p>" if self.chance(0.8) else ""))
            elif kind < 0.83:
                out.append(f"<h2>\x01{self.words(1, 6)}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>\x01{self.words(2, 14)}</li>" for _ in range(int(self.rng.integers(2, 5)))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote><p>\x01{self.prose()}</p></blockquote>")
            else:
                out.append("<table>" + "".join(f"<tr><td>\x01{self.words(1, 3)}</td><td>\x01{self.words(1, 5)}</td></tr>" for _ in range(2)) + "</table>")
        return "".join(out)

    def other(self, kind: str) -> str:
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        named = self.pick(_OTHER[kind])
        if self.chance(0.35) or tag == "div":
            tag = self.pick(["div", "div", "section", "ul" if kind == "menu" else "div"])
        else:
            named = named if self.chance(0.4) else ""
        if kind in ("menu", "share"):
            body = self.links(int(self.rng.integers(2, 9)))
        elif kind == "foot":
            body = f"&copy; {self.words(1, 3)} &middot; {self.words(2, 16, '.')}" if self.chance(0.6) else f"<p>&copy; {self.words(1, 8)}</p>" + self.links(3)
        elif kind == "form":
            body = f"<label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button>"
        elif kind == "reply":
            body = f"<h3>{self.words(1, 3)}</h3>" + "".join(f'<div class="{self.pick(_OTHER["reply"])}"><p>{self.prose()}</p></div>' for _ in range(int(self.rng.integers(1, 5))))
        elif kind == "head":
            body = f"<a href='/'>{self.words(1, 3)}</a>" + (f"<p>{self.words(2, 8)}</p>" if self.chance(0.5) else "")
        elif kind == "side":
            body = f"<h3>{self.words(1, 3)}</h3>" + (self.links(4) if self.chance(0.6) else f"<p>{self.words(4, 30, '.')}</p>")
        else:
            body = self.words(3, 30, ".") if self.chance(0.6) else f"<p>{self.words(3, 30, '.')}</p>"
        return f"{self.open(tag, named)}{body}</{tag}>"

    def page(self) -> str:
        before = [k for k in ("note", "head", "menu", "form", "advert", "share") if self.chance({"menu": 0.8, "advert": 0.5}.get(k, 0.3))]
        after = [k for k in ("share", "advert", "reply", "side", "note", "foot") if self.chance({"foot": 0.85}.get(k, 0.3))]
        if self.chance(0.3):
            self.rng.shuffle(before)
        main, tag = self.main(), "article" if self.chance(0.55) else self.pick(["div", "main", "section", "td"])
        if self.chance(0.25) and main.count("<p>") > 2:  # an advert or a note within
            cut = main.rindex("<p>")
            main = main[:cut] + self.other(self.pick(["advert", "side", "note", "share"])) + main[cut:]
        if self.chance(0.12):  # a bare page
            tag = ""
        main = main if not tag else f"{self.open(tag, self.pick(_MAIN) if tag != 'article' or self.chance(0.4) else '')}{main}</{tag}>"
        if self.chance(0.3):
            main = f"{self.open('div', self.pick(['wrapper', 'container', 'row', 'content']))}{main}</div>"
        if self.chance(0.04):
            main = ""
        body = "".join(map(self.other, before)) + main + "".join(map(self.other, after))
        end = "</body></html>" if self.chance(0.8) else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 12)}</title></head><body>{body}{end}"


def training_page(rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """Blocks of a written page and their labels. The mark of a label is a character that no page has."""
    found = blocks_of(_Grammar(rng).page())
    y = np.array(["\x01" in b.text for b in found], float)
    for b in found:
        b.text = b.text.replace("\x01", "").strip()
    kept = [k for k, b in enumerate(found) if b.text]
    return [found[k] for k in kept], y[kept]


@functools.cache
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    rng = np.random.default_rng(seed)
    sample = [(vectors(b), y) for b, y in (training_page(rng) for _ in range(pages)) if b]
    model = Labeller(rng)
    m, v, step = ({k: np.zeros_like(p) for k, p in model.p.items()} for _ in range(2)), None, 0
    m, v = m
    for epoch in range(epochs):
        order = np.array(sorted(range(len(sample)), key=lambda i: (len(sample[i][1]) + rng.random() * 8)))
        for at in rng.permutation(range(0, len(order), BATCH)):
            part = [sample[i] for i in order[at : at + BATCH]]
            x, mask = padded([s[0] for s in part])
            y = np.zeros(mask.shape)
            for i, (_, labels) in enumerate(part):
                y[: len(labels), i] = labels
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, g in model.gradient(x, mask, y).items():  # Adam
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def label(pages: list[list[Block]], model: Labeller) -> list[np.ndarray]:
    """Whether each block of each page is main text. Pages of like length are read together, a page that is longer by itself, part by part."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * len(pages[order[at + n]]) <= CELLS_AT_ONCE:
            n += 1
        part, at = order[at : at + n], at + n
        if n == 1:
            out[part[0]] = model.scores_of_page(pages[part[0]], CELLS_AT_ONCE) > 0
            continue
        x, mask = padded([vectors(pages[i]) for i in part])
        keep = model.scores(x, mask) > 0
        for k, i in enumerate(part):
            out[i] = keep[: len(pages[i]), k]
    return out


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks_of(p) for p in pages]
    return ["\n\n".join(b.text for b, k in zip(f, keep, strict=True) if k) for f, keep in zip(found, label(found, model), strict=True)]


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """The pages with the column ``into`` beside their others but for ``column``; another column of that name gives way to it."""
    given = pages.sparkSession.sparkContext.broadcast(trained())
    others = [c for c in pages.columns if c.lower() not in (column.lower(), into.lower())]
    rows = pages.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in others)).alias("__row"), F.col(f"`{column}`").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_turn(batches):
            lo = size = 0
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for hi in range(1, b.num_rows + 1):
                size += sizes[hi - 1]
                if hi == b.num_rows or hi - lo == PAGES_AT_ONCE or size + sizes[hi] > CHARS_AT_ONCE:
                    part = b.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(main_texts(part.column(1).to_pylist(), given.value), pa.string())], ["__row", "text"])
                    lo, size = hi, 0

    done = rows.mapInArrow(run, T.StructType([rows.schema["__row"], T.StructField("text", T.StringType())]))
    return done.select(*(F.col("__row")[c].alias(c) for c in others), F.col("text").alias(into))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
