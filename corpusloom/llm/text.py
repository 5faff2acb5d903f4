"""Small text helpers shared by the operators on noisy values."""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

_not_word = regex.compile(r"[^\p{L}\p{N}]+")
#: Letters without a decomposition, and their plain spelling.
_PLAIN = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})


class _Folded(dict):
    """Code points to their plain letters in lower-case text, each made when it is first met; ``words`` puts a space for all but letters and numbers."""

    def __init__(self, words: bool):
        super().__init__()
        self.words = words

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if not c.isascii():
            c = "".join(x for x in unicodedata.normalize("NFKD", c.translate(_PLAIN)) if not unicodedata.combining(x)).translate(_PLAIN)
        self[point] = out = _not_word.sub(" ", c) if self.words else c
        return out


_letters, _words = _Folded(False), _Folded(True)


def fold(s: str) -> str:
    """Lower case without accents."""
    s = s.lower()
    return s if s.isascii() else s.translate(_letters)


def plain(s: str | None) -> str:
    """Folded words and numbers, one space between them."""
    return " ".join(s.lower().translate(_words).split()) if s else ""


def banded(a: str, b: str, most: int) -> int:
    """Edit distance (insert, delete, replace) of a and b if it is at most ``most``, else most + 1; only the band is computed."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        new = [far] * (m + 1)
        if i <= most:
            new[0] = i
        best, x = new[0], a[i - 1]
        for j in range(lo, hi + 1):
            d = row[j - 1] + (x != b[j - 1])
            if row[j] + 1 < d:
                d = row[j] + 1
            if new[j - 1] + 1 < d:
                d = new[j - 1] + 1
            new[j] = d
            if d < best:
                best = d
        if best > most:
            return far
        row = new
    return min(row[m], far)


def with_swaps(a: str, b: str) -> int:
    """Edit distance in which exchanging two neighbours counts once."""
    n, m = len(a), len(b)
    before: list[int] = []
    row = list(range(m + 1))
    for i in range(1, n + 1):
        new = [i] + [0] * m
        for j in range(1, m + 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            new[j] = d
        before, row = row, new
    return row[m]


class NearWords:
    """A short list of words, each with the faults it allows, in which the first one near enough to a given word is found.

    A word with k faults keeps one of k + 1 segments unharmed: in front, at the end or, shifted by k at most, between.
    """

    def __init__(self, words: list[tuple[str, int]]):
        self.words = words
        self.front: dict[str, list[int]] = {}
        self.back: dict[str, list[int]] = {}
        self.inside: dict[str, list[tuple[int, int]]] = {}
        for i, (w, k) in enumerate(words):
            size = len(w) // (k + 1)
            self.front.setdefault(w[:size], []).append(i)
            self.back.setdefault(w[len(w) - size :], []).append(i)
            for n in range(1, k):
                self.inside.setdefault(w[n * size : (n + 1) * size], []).append((i, n * size))
        self.sizes = sorted({len(x) for x in self.front})
        self.between = sorted({(len(x), at) for x, held in self.inside.items() for _, at in held})
        self.reach = max((k for _, k in words), default=0)
        self.found: dict[str, int] = {}

    def find(self, w: str) -> int:
        """The place in the list of the first word near enough to w, or -1."""
        at = self.found.get(w)
        if at is None:
            near: set[int] = set()
            front, back, inside, n = self.front, self.back, self.inside, len(w)
            for m in self.sizes:
                if x := front.get(w[:m]):
                    near.update(x)
                if x := back.get(w[n - m :]):
                    near.update(x)
            for m, p in self.between:
                for q in range(max(0, p - self.reach), p + self.reach + 1):
                    if x := inside.get(w[q : q + m]):
                        near.update(i for i, of in x if of == p)
            near = {i for i in near if abs(len(self.words[i][0]) - n) <= self.words[i][1]}
            at = next((i for i in sorted(near) if banded(w, self.words[i][0], self.words[i][1]) <= self.words[i][1]), -1)
            if len(self.found) > 200_000:
                self.found.clear()
            self.found[w] = at
        return at


#: Signs, by their code, for which a string's positions are tabled; those of rarer signs are looked up when they are met.
TABLED = 64


class Signs(dict):
    """A code of its own for every sign of the strings that are compared with one another; 0 stands for none."""

    def __init__(self):
        super().__init__({c: k for k, c in enumerate(" abcdefghijklmnopqrstuvwxyz0123456789", 1)})

    def __missing__(self, c: str) -> int:
        self[c] = out = len(self) + 1
        return out


def pack(strings: list[str], signs: Signs) -> tuple[np.ndarray, np.ndarray]:
    """Codes (strings x longest, padded with 0) and lengths."""
    size = np.array([len(s) for s in strings], np.int32)
    out = np.zeros((len(strings), int(size.max()) if len(size) else 0), np.int32)
    code = signs.__getitem__
    for k, s in enumerate(strings):
        out[k, : len(s)] = [code(c) for c in s]
    return out, size


class Patterns:
    """Strings of at most 64 signs, made ready for many comparisons."""

    def __init__(self, strings: list[str], signs: Signs):
        self.codes, self.size = pack(strings, signs)
        self.masks = np.zeros((len(strings), TABLED), np.uint64)
        for p in range(min(self.codes.shape[1], 64)):
            live = np.flatnonzero((self.size > p) & (self.codes[:, p] < TABLED))
            self.masks[live, self.codes[live, p]] |= np.uint64(1 << p)

    def at(self, which: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """In which positions each of these strings has its sign, as bits."""
        rare = np.flatnonzero(sign >= TABLED)
        out = self.masks[which, np.where(sign < TABLED, sign, 0) if len(rare) else sign]
        if len(rare):
            same = self.codes[which[rare]][:, :64] == sign[rare, None]
            out[rare] = (same * (np.uint64(1) << np.arange(same.shape[1], dtype=np.uint64))).sum(1, dtype=np.uint64)
        return out


def distances(patterns: Patterns, a: np.ndarray, codes: np.ndarray, length: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of many pairs (pattern a[k] and text b[k]) at once, bit-parallel; the texts are packed with the patterns' signs."""
    one = np.uint64(1)
    m = patterns.size[a].astype(np.int64)
    pv = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    mv = np.zeros(len(a), np.uint64)
    score = m.copy()
    last = np.where(m > 0, one << (np.maximum(m, 1) - 1).astype(np.uint64), np.uint64(0))
    n = length[b]
    least = int(n.min()) if len(n) else 0
    for t in range(int(n.max()) if len(n) else 0):
        eq = patterns.at(a, codes[b, t])
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        change = ((ph & last) != 0).astype(np.int64) - ((mh & last) != 0)
        ph = (ph << one) | one
        mh = mh << one
        if t < least:
            score += change
            pv, mv = mh | ~(xv | ph), ph & xv
        else:
            live = t < n
            score += np.where(live, change, 0)
            pv, mv = np.where(live, mh | ~(xv | ph), pv), np.where(live, ph & xv, mv)
    return np.where(m == 0, n, score)
