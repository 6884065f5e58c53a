"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Words are compared by the gap-weighted subsequence kernel of length three: each three characters that stand in order within
SPAN places count DECAY for each place that they skip, so that ``i.d.i.o.t`` and ``idxiot`` stay near ``idiot``. Bounded spans
make the kernel an explicit sparse map, which is exact and needs no dynamic program for each pair. Landmarks are the
substrings of words that labels favour most, one after another, each for words that those before leave unexplained; a sentence has, for each landmark, the sum of its words' kernel values, which the
inverse square root of the landmarks' own kernel maps to Nyström features. The machine is trained on sentences: all of clean
documents, and of toxic ones those that resemble landmarks, of which the machine's own doubts sort out some in rounds; toxic
documents that no sentence explains are left out. A document's worst sentence, second-worst word, bad words together and length become a probability by a logistic
curve, which is fitted on documents that took no part in training (cross-fitting).

The training sample is bounded by TRAIN_TOXIC, TRAIN_CLEAN and TRAIN_CHARS, whatever the size of the tables; rows for it are
chosen by hash. Scoring reads every whole text.

Defined cases: null, empty and wordless texts score as a sentence without any match; words over WORD are read in overlapping
parts; letters that are set apart by blanks are read as a word too; letters of other scripts than Latin share 25 codes by hash; a document with several labels is toxic if one says so;
null labels and ids are left out of training; with no toxic or no clean training document all scores are 0 or, if all are
toxic, 1; repeated rows are scored each.
"""

from __future__ import annotations

import codecs
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import give_back, in_turn, keep_in_worker, rows_that_pass, table
from strandlake.llm.minhash import shingles
from strandlake.llm.token_ids import in_slices, texts_of

FOLDS = 5
TRAIN_TOXIC, TRAIN_CLEAN = 1_600, 3_200
#: Characters of one training document and of all; longer ones are not trained on, but scored like all others.
TRAIN_DOC_CHARS, TRAIN_CHARS = 50_000, 8_000_000
LANDMARKS, CLEAN_LANDMARKS, GRAMS = 64, 24, (4, 5, 6)
SPAN, DECAY = 5, 0.6
WORD = 24
#: Kernel values below this count as none; a landmark's own value is one.
LEAST = 0.45
#: The kernel's power, a kernel again, which sets whole words apart from words that share a part.
POWER = 3
#: Log likelihood ratio that a landmark has at least, which about one in a million reaches by chance.
LEAST_RATIO = 14.0
#: Kernel values with landmarks that make a sentence of a toxic document an example, in all.
LIKE = 0.5
#: Toxic documents, and their share, that hold a landmark.
LEAST_DOCS, LEAST_SHARE = 3, 0.01
#: Values of words nearer to 0 than this count as 0.
LEAST_VALUE = 0.1
ROUNDS, RIDGE = 3, 0.3
#: Words that a worker keeps.
MOST_WORDS = 300_000
FEATURES = 4

_CODES = 64
# letters and digits have codes of their own; 1 is a mark: a word's end, white space or any other sign
_code = np.ones(256, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
    _code[ord(_c)] = _i + 2
for _c in (0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)):
    _code[_c] = 38 + _c % 26
_alnum = _code > 1
_space = np.zeros(256, bool)
_space[[*range(9, 14), *range(28, 33), 0x85, 0xA0]] = True
_SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
_LETTER_LENGTH = 1
_EDGE = "".join(chr(i) for i in range(33, 256) if _code[i] == 1 and not _space[i])
#: (second, third) places of a subsequence after its first, and its weight.
_PLACES = [(j, k, DECAY ** (k - 2)) for k in range(2, SPAN + 1) for j in range(1, k)]


#: Letters of different codes that stand for the letters and digits beyond Latin-1.
_STANDS = "".join({int(_code[c]): chr(c) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}.values())


def _folded(found: UnicodeEncodeError) -> tuple[str, int]:
    """One character for each: letters and digits beyond Latin-1 by hash, blanks as blanks, a question mark for the others."""
    some = found.object[found.start : found.end]
    return "".join(_STANDS[(ord(c) * 0x9E3779B1 & 0xFFFFFFFF) * len(_STANDS) >> 32] if c.isalnum() else " " if c.isspace() else "?" for c in some), found.end


codecs.register_error("strandlake.folded", _folded)


def low(text: str | None) -> str:
    """Lower-case in Latin-1, into whose letters those of other scripts are folded."""
    return (text or "").lower().encode("latin-1", "strandlake.folded").decode("latin-1")


def parts_of(word: str) -> list[str]:
    """The word without marks at its ends, and without those in it; a long one in overlapping parts."""
    word = word.strip(_EDGE)
    if len(word) <= WORD:
        return [word] if word.isalnum() or not (plain := "".join(filter(str.isalnum, word))) else [word, plain]
    return list(dict.fromkeys(word[i : i + WORD] for i in range(0, len(word) - WORD // 2, WORD // 2)))


def spaced(text: str) -> list[str]:
    """Words whose letters are set apart by blanks."""
    return [m.replace(" ", "") for m in _SPACED.findall(text)]


def words_of(text: str | None) -> list[str]:
    """Lower-case words; letters that are set apart by blanks make one more."""
    found = low(text).split()
    if sum(map(_LETTER_LENGTH.__eq__, map(len, found))) > 3:
        found.extend(spaced(low(text)))
    return found


def sentences(text: str | None) -> list[set[str]]:
    """The words of each sentence, which ends at a line's end or at a word that ends in . ! or ?"""
    out: list[set[str]] = []
    for line in low(text).split("\n"):
        now: set[str] = set()
        for w in words_of(line):
            now.add(w)
            if w[-1] in ".!?":
                out.append(now)
                now = set()
        if now:
            out.append(now)
    return out


def encode(words: list[str], marks: bool = True) -> np.ndarray:
    """Codes of the words, with a mark at both ends if wanted; -1 after them."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    c = _code[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    first = int(marks)
    out = np.full((len(words), (int(size.max()) if len(size) else 0) + 2 * first), -1, np.int64)
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at + first] = c
    if marks:
        out[:, 0] = 1
        out[np.arange(len(words)), size + 1] = 1
    return out


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of all bounded subsequences of three of each word; number -1 where there is none."""
    n = codes.shape[1]
    f, w = [np.full((len(codes), 1), -1, np.int64)], [np.ones(1)]
    for j, k, weight in _PLACES:
        if k < n:
            a, b, c = codes[:, : n - k], codes[:, j : n - k + j], codes[:, k:]
            f.append(np.where(c < 0, -1, (a * _CODES + b) * _CODES + c))
            w.append(np.full(f[-1].shape[1], weight))
    return np.concatenate(f, axis=1), np.concatenate(w)


def norms(f: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Square roots of the words' kernel with themselves; equal subsequences of a word add up first."""
    order = np.argsort(f, axis=1, kind="stable")
    s, v = np.take_along_axis(f, order, 1), w[order]
    v = np.where(s < 0, 0, v)
    group = np.concatenate([np.zeros((len(f), 1), np.int64), np.cumsum(s[:, 1:] != s[:, :-1], axis=1)], axis=1)
    flat = (group + np.arange(len(f))[:, None] * f.shape[1]).ravel()
    total = np.bincount(flat, v.ravel(), minlength=f.size).reshape(f.shape)
    return np.sqrt((total**2).sum(axis=1)) + 1e-12


def _shortest(size: np.ndarray) -> np.ndarray:
    """What the norms of words of these sizes are at least: that of as many different subsequences."""
    each = np.array([sum(w * w * max(0, n + 2 - k) for _, k, w in _PLACES) for n in range(WORD + 1)])
    return np.sqrt(each)[size] + 1e-12


class Kernel:
    """The kernel of any words with fixed landmarks, normalised; values below LEAST are 0.

    Only words that resemble one of the first n_bad landmarks, those of toxic documents, have values.
    """

    def __init__(self, landmarks: list[str], n_bad: int | None = None) -> None:
        self.landmarks, self.n_bad = landmarks, len(landmarks) if n_bad is None else n_bad
        f, w = subsequences(encode(landmarks, marks=False))  # a landmark may hold marks itself
        own = norms(f, w)
        used = np.unique(f[f >= 0])
        self.row = np.zeros(_CODES**3 + 1, np.int32)  # number -1 is the last, and has no row
        self.row[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, len(landmarks)))
        for i in range(len(landmarks)):
            ok = f[i] >= 0
            np.add.at(self.table[:, i], self.row[f[i][ok]], w[ok] / own[i])
        self.most_of = self.table[:, : self.n_bad].max(axis=1)[self.row[:-1]].astype(np.float32)  # by number, at least 0
        gram = ((w @ self.table[self.row[f]]) / own[:, None]) ** POWER
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        #: Kernel values to Nyström features.
        self.root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of words with a value that counts, and their values."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order, at, values = np.argsort(size, kind="stable"), [], []
        for lo in range(0, len(words), 8192):  # words of like length together
            part = order[lo : lo + 8192]
            codes = encode([words[i] for i in part])
            for few in np.split(m := np.flatnonzero(self._may(codes, size[part])), range(2048, len(m), 2048)):
                f, w = subsequences(codes[few])
                rows = self.row[f]
                i, j = np.nonzero(rows)  # few of a word's subsequences are any landmark's
                if not len(i):
                    continue
                start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                k = np.zeros((len(few), len(self.landmarks)))
                k[i[start]] = np.add.reduceat(self.table[rows[i, j]] * w[j, None], start)
                near = np.flatnonzero((k[:, : self.n_bad] >= LEAST * _shortest(size[part[few]])[:, None]).any(axis=1))
                k = k[near] / norms(f[near], w)[:, None]
                k[k < LEAST] = 0
                k **= POWER
                keep = k[:, : self.n_bad].any(axis=1)
                at.append(part[few[near[keep]]])
                values.append(k[keep])
        return (np.concatenate(at), np.concatenate(values)) if at else (np.zeros(0, np.int64), np.zeros((0, len(self.landmarks))))

    def _may(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the kernel of each word with some landmark can count, by a bound that is quick to tell."""
        c = np.where(codes < 0, 0, codes).astype(np.int32)
        n, bound = c.shape[1], np.zeros(len(c), np.float32)
        for j, k, weight in _PLACES:
            if k < n:
                bound += self.most_of[(c[:, : n - k] * _CODES + c[:, j : n - k + j]) * _CODES + c[:, k:]].sum(axis=1) * np.float32(weight)
        return bound >= np.float32(0.999 * LEAST) * _shortest(size)


def suspects(texts: list[str], kernel: Kernel) -> list[tuple[int, list[str]]]:
    """For each lower-case text its number of words and those occurrences whose kernel may count, in order.

    One bound over all characters at once: the best that any landmark gives to each subsequence, summed by word. Triples that
    reach over a word's end only raise it. Long words and words with marks in them, which are read in other forms too, and
    letters set apart are always handed on.
    """
    flat = np.frombuffer((" " + " ".join(texts) + " " * (SPAN + 1)).encode("latin-1"), np.uint8)
    c = _code[flat].astype(np.int32)
    n, gain = len(flat), np.zeros(len(flat), np.float32)
    for j, k, weight in _PLACES:
        gain[: n - k] += kernel.most_of[(c[: n - k] << 12) + (c[j : n - k + j] << 6) + c[k:]] * np.float32(weight)
    space, sign = _space[flat], ~_alnum[flat]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    edges = np.cumsum([1, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(start, edges)
    if not len(start):
        return [(0, [])] * len(texts)
    letters = np.add.reduceat((~sign).astype(np.int64), start - 1)
    inner = np.add.reduceat((sign[1:-1] & ~space[1:-1] & ~sign[:-2] & ~sign[2:]).astype(np.int64), np.maximum(start - 1, 0))
    bound = np.add.reduceat(gain, start - 1)
    may = (bound >= np.float32(0.99 * LEAST) * _shortest(np.minimum(letters, WORD))) & (letters > 1) | (inner > 0) | (end - start > WORD)
    out = []
    for t, text in enumerate(texts):
        lo, hi, base = cuts[t], cuts[t + 1], edges[t]
        at = np.flatnonzero(may[lo:hi]) + lo
        found = [text[a:b] for a, b in zip((start[at] - base).tolist(), (end[at] - base).tolist(), strict=True)]
        apart = spaced(text) if ((end[lo:hi] - start[lo:hi]) == 1).sum() > 3 else []
        out.append((int(hi - lo) + len(apart), found + apart))
    return out


class Lexicon:
    """Words that a process has met, and what those few say that say anything: kernel values, or with coefficients one number."""

    def __init__(self, kernel: Kernel, coefficient: np.ndarray | None = None) -> None:
        self.kernel, self.coefficient = kernel, coefficient
        self.known: set[str] = set()
        self.matched: dict[str, np.ndarray | float] = {}
        self.bad: set[str] = set()

    def learn(self, words: set[str]) -> None:
        new = list(words - self.known)
        if len(self.known) + len(new) > MOST_WORDS and self.known:
            self.known, self.matched, self.bad = set(), {}, set()
            new = list(words)
        for lo in range(0, len(new), 65536):
            some = new[lo : lo + 65536]
            parts = [(i, p) for i, w in enumerate(some) for p in parts_of(w)]
            at, k = self.kernel([p for _, p in parts])
            best: dict[str, np.ndarray] = {}
            for j, row in zip(at.tolist(), k, strict=True):
                w = some[parts[j][0]]
                best[w] = np.maximum(best[w], row) if w in best else row
            if self.coefficient is None:
                self.matched |= best
            elif best:
                said = settled(np.array(list(best.values())) @ self.coefficient)
                self.matched.update((w, g) for w, g in zip(best, said.tolist(), strict=True) if g)
                self.bad.update(w for w, g in zip(best, said.tolist(), strict=True) if g > 0)
        self.known.update(new)

    def values(self, words: list[str]) -> np.ndarray:
        return np.array([self.matched[w] for w in words]).reshape(len(words), len(self.kernel.landmarks))


def settled(value: np.ndarray) -> np.ndarray:
    """Words' values, of which small ones count as none."""
    return np.where(np.abs(value) < LEAST_VALUE, 0.0, value)


class Sample:
    """The training documents as numbers of words, and the substrings of their words, counted once for all folds."""

    def __init__(self, texts: list[str | None], toxic: list[int]) -> None:
        self.toxic = np.array(toxic, np.int64)
        number: dict[str, int] = {}
        self.found: list[list[np.ndarray]] = []
        self.size, self.bags = np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            self.found.append([np.array(sorted(number.setdefault(w, len(number)) for w in s), np.int32) for s in sentences(t)])
            all_ = words_of(t)
            self.size[i] = len(all_)
            self.bags.append(np.unique(np.array([number[w] for w in all_], np.int32), return_counts=True))
        self.words = list(number)
        del number
        self.bags, self.times = [b for b, _ in self.bags], [t for _, t in self.bags]
        held = np.bincount(np.concatenate([np.zeros(0, np.int32), *self.bags]), minlength=len(self.words))
        self.grams = {n: self._substrings(n, held) for n in GRAMS}

    def _substrings(self, n: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Numbers of words and of their substrings that enough documents hold, and these."""
        words, hashes, places = [], [], []
        for lo in range(0, len(self.words), 32_768):
            parts = [(i, p) for i in range(lo, min(lo + 32_768, len(self.words))) for p in parts_of(self.words[i]) if len(p) > 2]
            h = _hashes(encode([p for _, p in parts]), n)
            row, place = np.nonzero(h)
            words.append(np.array([i for i, _ in parts], np.int32)[row])
            hashes.append(h[row, place])
            places.append(place.astype(np.int32))
        if not hashes:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), []
        word, h, place = np.concatenate(words), np.concatenate(hashes), np.concatenate(places)
        order = np.lexsort((word, h))
        word, h, place = word[order], h[order], place[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (word[1:] != word[:-1])]  # a word counts once
        word, h, place = word[once], h[once], place[once]
        start = np.r_[True, h[1:] != h[:-1]]
        gram = np.cumsum(start) - 1
        enough = np.bincount(gram, held[word]) >= LEAST_DOCS
        keep = enough[gram]
        new = np.cumsum(enough) - 1
        first = np.flatnonzero(start & keep)
        names = []
        for w, at in zip(word[first].tolist(), place[first].tolist(), strict=True):
            # a place counts from the mark of the part; a long word's parts overlap, so that one of them has it
            names.append(next((g for p in parts_of(self.words[w]) if len(g := f"#{p}#"[at : at + n]) == n), ""))
        return word[keep], new[gram[keep]].astype(np.int32), names

    def landmarks(self, inside: np.ndarray, most: int = LANDMARKS) -> list[str]:
        """Substrings of words that toxic documents hold more often than by chance, best first by their likelihood ratio."""
        held = {t: [self.bags[i] for i in inside if self.toxic[i] == t] for t in (0, 1)}
        df = {t: np.bincount(np.concatenate([np.zeros(0, np.int32), *x]), minlength=len(self.words)).astype(float) for t, x in held.items()}

        def ratios(word: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
            pos, neg = (np.bincount(gram, df[t][word], minlength=n) for t in (1, 0))
            rate1, rate0 = (pos + 0.1) / len(held[1]), (neg + 0.1) / len(held[0])
            return np.where((rate1 > 4 * rate0) & (pos >= LEAST_SHARE * len(held[1])), pos * np.log(rate1 / rate0) - len(held[1]) * (rate1 - rate0), 0)

        words, grams, names = [], [], []
        for word, gram, of in self.grams.values():
            z = ratios(word, gram, len(of))
            best = np.argsort(-z, kind="stable")[: 8 * most]
            best = best[z[best] >= LEAST_RATIO]
            number = np.full(len(of), -1)
            number[best] = np.arange(len(best)) + len(names)
            keep = number[gram] >= 0
            words.append(word[keep])
            grams.append(number[gram[keep]])
            names.extend(of[k] for k in best)
        word, gram = np.concatenate(words), np.concatenate(grams)
        chosen: list[str] = []
        while len(chosen) < most and names:
            z = ratios(word, gram, len(names))
            best = max(range(len(names)), key=lambda k: (z[k], len(names[k]), names[k]))
            if z[best] < LEAST_RATIO:
                break
            if names[best]:
                chosen.append(names[best])
            explained = word[gram == best]  # words that a landmark is in say nothing for another
            most_of = explained[np.argmax(df[1][explained])]
            if names[best] and df[1][most_of] > 0.9 * df[1][explained].sum() and len(self.words[most_of]) <= WORD:
                chosen[-1] = f"#{parts_of(self.words[most_of])[-1]}#"
            for t in (0, 1):
                df[t][explained] = 0
        return chosen

    def confused(self, inside: np.ndarray, kernel: Kernel, most: int = CLEAN_LANDMARKS) -> list[str]:
        """Words of clean documents that landmarks resemble: more landmarks, from which the machine learns what not to mind."""
        row, values = self.values(kernel)
        df = {t: np.bincount(np.concatenate([np.zeros(0, np.int32), *(self.bags[i] for i in inside if self.toxic[i] == t)]), minlength=len(self.words)) for t in (0, 1)}
        toxic = self.toxic[inside].sum()
        share = (df[1] + 0.5) / (toxic + 1) / ((df[0] + 0.5) / (len(inside) - toxic + 1))
        like = values.max(axis=1)[row]
        at = np.flatnonzero((like >= 0.2) & (df[0] >= 2) & (share < 2))
        best = at[np.argsort(-(df[0] * like)[at], kind="stable")]
        found = (parts_of(self.words[i])[0] for i in best.tolist())
        return list(dict.fromkeys(f"#{w}#" for w in found if w))[:most]

    def values(self, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
        """For each word the row of its kernel values, and these; row 0 is of words without any."""
        row, values = np.zeros(len(self.words), np.int32), [np.zeros((1, len(kernel.landmarks)))]
        for lo in range(0, len(self.words), 65_536):
            lexicon = Lexicon(kernel)
            some = self.words[lo : lo + 65_536]
            lexicon.learn(set(some))
            at = [i for i, w in enumerate(some) if w in lexicon.matched]
            row[np.array(at, np.int64) + lo] = np.arange(len(at)) + sum(map(len, values))
            values.append(lexicon.values([some[i] for i in at]))
        return row, np.concatenate(values)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n codes of each word; 0 where the word ends."""
    m = max(0, codes.shape[1] - n + 1)
    h = np.zeros((len(codes), m), np.uint64)
    for j in range(n):
        h = (h ^ (codes[:, j : j + m].astype(np.uint64) + np.uint64(n))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.where(codes[:, n - 1 : n - 1 + m] < 0, np.uint64(0), h | np.uint64(1))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last coefficient is the offset, which is not shrunk."""
    a = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(a.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(15):
        on = y * (a @ w) < 1
        left = a[on] * weight[on, None]
        new = np.linalg.solve(left.T @ a[on] + np.diag(penalty), left.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


class Model:
    """landmarks, the coefficients over kernel values (Nyström map included), the offset, and the logistic curve over features."""

    def __init__(self, landmarks: list[str], n_bad: int, coefficient: np.ndarray, offset: float) -> None:
        self.landmarks, self.n_bad, self.coefficient, self.offset = landmarks, n_bad, coefficient, offset
        self.slope, self.shift = np.zeros(FEATURES), 0.0

    def features(self, bad: list[float] | np.ndarray, times: list[int] | np.ndarray, sentences_: list[float], n_words: int) -> np.ndarray:
        """The worst sentence, the second-worst word, all bad words together, and the length.

        bad: positive values of words; times: how often each occurs; sentences_: summed values of sentences with any of them.
        """
        out = np.array([self.offset, 0.0, 0.0, np.log1p(n_words)])
        if len(bad):
            word = np.sort(np.repeat(np.asarray(bad, float), np.minimum(times, 2)))
            out[0] += max([0.0, *sentences_])
            out[1:3] = word[-2] if len(word) > 1 else 0.0, np.minimum(word, 2.0).sum()
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.slope + self.shift, -30, 30)))


def constant(score: float) -> Model:
    model = Model([], 0, np.zeros(0), 0.0)
    model.shift = 1e9 if score else -1e9
    return model


def _pooled(found: list[np.ndarray], row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Summed kernel values of those sentences that have any match."""
    hits = [r[r > 0] for r in (row[s] for s in found)]
    return np.array([values[h].sum(axis=0) for h in hits if len(h)]).reshape(-1, values.shape[1])


def _train(sample: Sample, inside: np.ndarray) -> Model:
    """A model without its curve."""
    landmarks = sample.landmarks(inside)
    if not landmarks:
        return Model([], 0, np.zeros(0), 0.0)
    n_bad = len(landmarks)
    landmarks += [w for w in sample.confused(inside, Kernel(landmarks)) if w not in landmarks]
    kernel = Kernel(landmarks, n_bad)
    root, (row, values) = kernel.root, sample.values(kernel)
    clean, bad, silent = [np.zeros((1, len(landmarks)))], [], 1
    for i in inside.tolist():
        pooled = _pooled(sample.found[i], row, values)
        if not sample.toxic[i]:
            clean.append(pooled)
            silent += len(sample.found[i]) - len(pooled)
        elif len(pooled):
            bad.append(pooled)
    if not bad:
        return Model([], 0, np.zeros(0), 0.0)
    x0 = np.concatenate(clean) @ root
    weight = np.ones(len(x0))
    weight[0] = max(1, silent)  # all sentences without a match are the same
    weight *= 4 * len(bad) / weight.sum()
    # all sentences of a toxic document that resemble a landmark are its examples, of one weight together; the worst alone would
    # be the same few words' over and over
    like = [p[:, :n_bad].sum(axis=1) for p in bad]
    picked = [(p @ root)[(v >= LIKE) | (v == v.max())] for p, v in zip(bad, like, strict=True)]
    for k in range(ROUNDS):
        x, share = np.concatenate([x0, *picked]), np.concatenate([np.full(len(p), 1 / len(p)) for p in picked])
        y = np.r_[-np.ones(len(x0)), np.ones(len(share))]
        coefficient = fit_svm(x, y, np.r_[weight, share])
        near = [p @ coefficient[:-1] + coefficient[-1] for p in picked]
        # examples that the machine doesn't believe are left out, and at last documents without any other
        picked = [p[v > 0] if (v > 0).any() else p for p, v in zip(picked, near, strict=True) if k < ROUNDS - 2 or (v > 0).any()] or picked
    return Model(landmarks, n_bad, root @ coefficient[:-1], float(coefficient[-1]))


def _curve(x: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of the logistic curve, by Newton steps on scaled features, with smoothed targets."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.r_[np.zeros(x.shape[1]), np.log((n1 + 1) / (n0 + 1))], np.r_[np.full(x.shape[1], 0.5), 1e-6]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, a.T @ (target - p) - ridge * w)
        w = w + step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _apart(texts: list[str | None]) -> list[int]:
    """Indices of texts without those that are likely near copies of one before, whose words would count many times over."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, t in enumerate(texts):
        s = shingles((t or "").encode("utf-8", "replace"))
        keys = {(k, int((s * np.uint64(2 * k + 0x9E3779B97F4A7C15)).min())) for k in range(4)} if len(s) else set()
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


def train(texts: list[str | None], toxic: list[int], folds: int = 3) -> Model:
    some = _apart(texts)
    texts, toxic = [texts[i] for i in some], [toxic[i] for i in some]
    if len(set(toxic)) < 2:
        return constant(1.0 if toxic and toxic[0] else 0.0)
    sample = Sample(texts, toxic)
    y, fold = sample.toxic, np.zeros(len(toxic), np.int64)
    for t in (0, 1):
        fold[y == t] = np.arange((y == t).sum()) % folds
    x = np.zeros((len(y), FEATURES))
    for k in range(folds):
        model = _train(sample, np.flatnonzero(fold != k))
        if model.landmarks:
            row, values = sample.values(Kernel(model.landmarks, model.n_bad))
            value = settled(values @ model.coefficient)[row]
            for i in np.flatnonzero(fold == k).tolist():
                own = value[sample.bags[i]]
                x[i] = model.features(own[own > 0], sample.times[i][own > 0], [value[s].sum() for s in sample.found[i]], int(sample.size[i]))
    model = _train(sample, np.arange(len(y)))
    model.slope, model.shift = _curve(x, y)
    return model if model.landmarks else constant(0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """docs(doc_id, text) and labels(doc_id, toxic), of which held-out rows are not looked at."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    by_doc = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = by_doc.where("toxic = 1").orderBy(*order).limit(TRAIN_TOXIC).unionByName(by_doc.where("toxic = 0").orderBy(*order).limit(TRAIN_CLEAN))
    size = F.coalesce(F.length("text"), F.lit(0))
    chosen = docs.where(size <= TRAIN_DOC_CHARS).select(F.col("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    once = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    made = once.repartition(1).mapInArrow(_train_batches, "model binary").collect()
    return pickle.loads(bytes(made[0]["model"])) if made else constant(0.0)


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sample, which its parameters bound, in one task; the driver gets the model only."""
    keep_in_worker("toxicity training", lambda: None)
    rows = sorted((i, y, t or "") for b in batches for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
    total, kept = 0, []
    for k in np.random.default_rng(5).permutation(len(rows)).tolist():
        if total + len(rows[k][2]) <= TRAIN_CHARS:
            total += len(rows[k][2])
            kept.append(rows[k])
    kept.sort()
    model = train([t for _, _, t in kept], [y for _, y, _ in kept])
    del rows, kept
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


_lexicons: dict[str, Lexicon] = {}


def _lexicon(model: Model) -> Lexicon:
    """Of this process, whatever the number of its tasks; that of another model goes."""
    keep_in_worker("toxicity", _lexicons.clear)
    key = repr((model.landmarks, model.coefficient.tolist()))
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(Kernel(model.landmarks, model.n_bad), model.coefficient)
    return _lexicons[key]


def _scorer(model: Model):
    lexicon = _lexicon(model) if model.landmarks else None

    def one(text: str, n_words: int, found: list[str]) -> np.ndarray:
        times = Counter(w for w in found if w in lexicon.bad)
        if not times:
            return model.features([], [], [], n_words)
        said = lexicon.matched
        sums = [sum(said.get(w, 0.0) for w in sorted(s)) for s in sentences(text) if not times.keys().isdisjoint(s)]
        return model.features([said[w] for w in sorted(times)], [times[w] for w in sorted(times)], sums, n_words)

    def some(texts: list[str | None]) -> np.ndarray:
        plain = [low(t) for t in texts]
        found = suspects(plain, lexicon.kernel)
        lexicon.learn({w for _, f in found for w in f})
        return model.probability(np.array([one(t, n, f) for t, (n, f) in zip(plain, found, strict=True)]))

    def score(texts: list[str | None]) -> np.ndarray:
        if lexicon is None:
            return model.probability(np.zeros((len(texts), FEATURES)))
        return np.concatenate([np.zeros(0), *(some(texts[lo:hi]) for lo, hi in in_slices(texts))])

    return score


def _scores(score, column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(score(texts) for _, texts in texts_of(column))])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for docs(doc_id, text)."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(given.value)
        for b in in_turn(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(score, b.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, all columns, that score below least."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = _scorer(given.value)
        return lambda texts: (_scores(score, texts) < least).tolist()

    return rows_that_pass(docs, "text", make)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_on(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
