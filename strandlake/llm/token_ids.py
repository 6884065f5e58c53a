"""Token ids of whole texts with the public lower-casing word tokenizer, by way of the distinct words of the texts.

The tokenizer cuts a text into words, single digits and runs of marks, and merges only inside these. They are tokenised
once for each worker process, many in one call, and looked up from then on; the table of them is emptied when it is full. Cutting,
hashing and looking up are numpy over all characters of many texts at once: a part's hashes, of 64 bits each and two of them, are
differences of running sums. Texts with letters beyond Latin-1 or with the tokenizer's special strings go to the tokenizer as they are.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandlake.llm.common import give_back, keep_in_worker

#: Words that a worker keeps, about 40 MB with their table, slots of its table for them, and characters that are taken in at once.
MOST_WORDS, SLOTS = 600_000, 1 << 20
CHARS_AT_ONCE = 1 << 18
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_LATIN = bytes(range(256)).decode("latin-1")
_LOWER = _LATIN.lower().encode("latin-1")
#: Kinds of lower-case characters: 0 white space, 1 letters, 2 digits, 3 marks.
_KIND = np.array([0 if c in "\t\n\x0b\x0c\r \x85\xa0" else 1 if re.match(f"[{_LETTER}]", c) else 2 if re.match(f"[{_NUMBER}]", c) else 3 for c in _LATIN], np.uint8)
#: Endings that are cut off with their apostrophe.
_SHORT = ("s", "t", "m", "d", "re", "ve", "ll")
_rng = np.random.default_rng(20240310)
#: Of two hashes: a number for each character, and what a place multiplies it by.
_VALUES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = tuple(int(x) * 8 + 5 for x in _rng.integers(1, 1 << 60, 2))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict[tuple[str, bool], PartTokenizer] = {}


def pieces_of(text: str) -> Iterator[str]:
    """The text in runs of bounded length that end at white space; only a part that is longer stays whole."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE:
        cut = max(text.rfind(" ", at, at + CHARS_AT_ONCE), text.rfind("\n", at, at + CHARS_AT_ONCE))
        if cut <= at:
            found = re.compile(r"[ \n]").search(text, at + CHARS_AT_ONCE)
            cut = found.start() if found else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def plain(text: str) -> bool:
    """Whether words can be looked up: Latin-1 is composed as it is and lower-cases letter by letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # the first ones times the power where they end
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def parts_at(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the parts of lower-case Latin-1 text, which ends with white space."""
    kind = _KIND[low]
    change = kind[1:] != kind[:-1]
    start, end = np.empty(len(low), bool), np.empty(len(low), bool)
    start[0], end[-1] = True, False
    start[1:], end[:-1] = change | (kind[1:] == 2), change | (kind[:-1] == 2)
    start &= kind != 0
    end &= kind != 0
    quote = np.flatnonzero((low == 39) & start)  # the first of its marks, so that no other mark takes it
    if len(quote):
        around = np.concatenate([low, np.zeros(3, np.uint8)])
        for tail in _SHORT:
            at = quote[(around[quote[:, None] + np.arange(1, len(tail) + 1)] == np.frombuffer(tail.encode(), np.uint8)).all(axis=1)]
            last = at + len(tail)
            end[at], start[at + 1], end[last] = False, False, True
            start[last + 1] = kind[last + 1] != 0
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class PartTokenizer:
    """special_as_text: the strings of special tokens in a text are ordinary text and never give their ids."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.special_as_text = path, special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError("a tokenizer with marked word ends is needed")
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": split}))
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith("</w>")]] = True
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2
        self._clear()

    def _clear(self) -> None:
        self.key, self.slot = np.zeros((2, SLOTS), np.uint64), np.full(SLOTS, -1, np.int32)
        self.start, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.n = self.used = 0

    def _hashes(self, low: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.powers[0][0]) <= len(low):
            self.powers = [tuple(powers(x, len(low) + 1024) for x in (b, pow(b, -1, 1 << 64))) for b in _BASES]
        out, upto = np.empty((2, len(first)), np.uint64), np.zeros(len(low) + 1, np.uint64)
        for k in range(2):
            np.cumsum(_VALUES[k][low] * self.powers[k][0][: len(low)], out=upto[1:])
            out[k] = (upto[end] - upto[first]) * self.powers[k][1][first]
        return out

    def _places(self, h: np.ndarray) -> np.ndarray:
        """The number of each part, -1 where it is not known."""
        out, at = np.full(h.shape[1], -1, np.int64), ((h[0] * _SPREAD) >> np.uint64(44)).astype(np.int64)
        left = np.arange(h.shape[1])
        while len(left):
            here = at[left]
            there = self.slot[here]
            hit = (there >= 0) & (self.key[0][here] == h[0][left]) & (self.key[1][here] == h[1][left])
            out[left[hit]] = there[hit]
            more = (there >= 0) & ~hit
            left = left[more]
            at[left] = (here[more] + 1) & (SLOTS - 1)
        return out

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        """Takes different parts into the table."""
        at, left = ((h[0] * _SPREAD) >> np.uint64(44)).astype(np.int64), np.arange(h.shape[1])
        while len(left):
            free = left[self.slot[at[left]] < 0]
            _, once = np.unique(at[free], return_index=True)
            new = free[once]
            self.slot[at[new]] = number[new]
            self.key[:, at[new]] = h[:, new]
            left = np.setdiff1d(left, new, assume_unique=True)
            at[left] = (at[left] + 1) & (SLOTS - 1)

    def _learn(self, h: np.ndarray, new: list[str]) -> None:
        ids = np.array(self.words.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(new):
            raise ValueError("words and word ends differ")
        size = np.diff(last, prepend=-1)
        n, total = self.n, len(ids)
        while len(self.start) < n + len(new):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + total] = ids
        self.size[n : n + len(new)] = size
        self.start[n : n + len(new)] = self.used + last + 1 - size
        self._put(h, np.arange(n, n + len(new)))
        self.used += total
        self.n += len(new)

    def _numbers(self, raw: bytes, low: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self._hashes(low, first, end)
        at = self._places(h)
        while (unknown := np.flatnonzero(at < 0)).size:
            _, once = np.unique(h[0][unknown], return_index=True)
            if self.n and self.n + len(once) > MOST_WORDS:
                self._clear()
                at[:] = -1
                continue
            new = unknown[np.sort(once)]
            self._learn(h[:, new], [raw[a:b].decode("latin-1") for a, b in zip(first[new].tolist(), end[new].tolist(), strict=True)])
            at[unknown] = self._places(h[:, unknown])
        return at

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; of texts of up to about CHARS_AT_ONCE characters in all, a longer one goes by itself."""
        if len(texts) == 1 and len(texts[0] or "") > CHARS_AT_ONCE:
            return [np.concatenate([self.encode_all([x])[0] for x in pieces_of(texts[0])])] if plain(texts[0]) else [self._whole(texts[0])]
        easy = [t is not None and len(t) <= 2 * CHARS_AT_ONCE and plain(t) for t in texts]
        given = [t.encode("latin-1") if e else b"" for t, e in zip(texts, easy, strict=True)]
        raw = b"\n".join([*given, b""]).translate(_LOWER)
        low = np.frombuffer(raw, np.uint8)
        first, end = parts_at(low)
        at = self._numbers(raw, low, first, end)
        size = self.size[at]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[at] - (upto - size), size) + np.arange(int(size.sum()))]
        edges = np.cumsum([len(x) + 1 for x in given])
        cuts = np.r_[0, upto][np.searchsorted(first, edges)]
        out = np.split(ids, cuts[:-1])
        return [x if e else self._whole(t or "") for x, e, t in zip(out, easy, texts, strict=True)]

    @functools.cached_property
    def tokenizer(self):
        """The tokenizer itself, loaded when a text needs it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = self.special_as_text
        return made

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def part_tokenizer(path: str, special_as_text: bool = False) -> PartTokenizer:
    keep_in_worker("token ids", _loaded.clear)
    key = (path, special_as_text)
    if key not in _loaded:
        _loaded[key] = PartTokenizer(path, special_as_text)
        give_back()  # the file's contents
    return _loaded[key]


def in_slices(texts: list[str | None], chars: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices with about so many characters; a text that is longer stands alone."""
    return slices_of([len(t or "") for t in texts], chars)


def slices_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def texts_of(column: pa.Array, chars: int = CHARS_AT_ONCE) -> Iterator[tuple[int, list[str | None]]]:
    """First place and texts of slices of a batch's column, one after another, so that not all of them are strings at once."""
    for lo, hi in slices_of(pc.fill_null(pc.binary_length(column), 0).to_pylist(), chars):
        yield lo, column.slice(lo, hi - lo).to_pylist()
