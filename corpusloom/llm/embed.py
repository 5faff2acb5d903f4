"""Vectors of tokens from random walks over the graph of records, attributes and tokens.

A walk goes from a record over one of its attributes to a token and from there to another record that has the token
under the same attribute. ``skip_gram`` trains on drawn walks of records that fit into memory. ``Contexts`` takes, over
all records, what such walks meet on average around a token, less what they meet around any token, which is what negative
samples take away; its tokens are hashed, so its size does not grow with the records. A token's vector is that of its
hashed letter trigrams plus its trained vector, so a misspelt token stays near the right one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

DIMS = 48
GRAMS = 1 << 15


def gram_table(dims: int = DIMS, seed: int = 11) -> np.ndarray:
    """Fixed random vectors of hashed letter n-grams."""
    return np.random.default_rng(seed).standard_normal((GRAMS, dims)).astype(np.float32)


def grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of tokens, with an edge mark on either side: (numbers, how many of each token)."""
    points = np.frombuffer("".join([f"<{t}>" for t in tokens]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(t) + 2 for t in tokens), np.int64, len(tokens))
    h = (points[:-2] * np.uint64(0x9E3779B1) ^ points[1:-1] * np.uint64(0x85EBCA77) << np.uint64(7) ^ points[2:] * np.uint64(0xC2B2AE3D) << np.uint64(13)) * np.uint64(0x27D4EB2F165667C5)
    ends = np.cumsum(size)
    inside = np.ones(len(points), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return ((h >> np.uint64(40)) % np.uint64(GRAMS)).astype(np.int64)[inside[:-2]], size - 2


def _add(rows: np.ndarray, which: np.ndarray, more: np.ndarray) -> None:
    """Adds to rows, which may be named several times; over flat numbers, for which NumPy has a fast way."""
    dims = rows.shape[1]
    np.add.at(rows.reshape(-1), (which[:, None] * dims + np.arange(dims)).ravel(), more.ravel())


def skip_gram(records: list[list[tuple[str, str]]], dims: int = DIMS, walks: int = 6, length: int = 8, window: int = 2, epochs: int = 2, negatives: int = 4, seed: int = 5) -> dict[str, np.ndarray]:
    """Unit vectors of the tokens of the sampled records, each a list of (attribute, token)."""
    rng = np.random.default_rng(seed)
    tokens = {t: i for i, t in enumerate(sorted({t for r in records for _, t in r}))}
    nodes = {n: i for i, n in enumerate(sorted({n for r in records for n in r}))}
    of_node = np.array([tokens[t] for _, t in sorted(nodes)], np.int64)
    full = [r for r in records if r]
    if len(tokens) < 2 or not full:
        return {}
    rec_of = np.repeat(np.arange(len(full)), [len(r) for r in full])
    node_of = np.array([nodes[n] for r in full for n in r], np.int64)
    r_at = np.r_[0, np.cumsum([len(r) for r in full])]
    order = np.argsort(node_of, kind="stable")
    n_at = np.r_[0, np.cumsum(np.bincount(node_of, minlength=len(nodes)))]
    by_node = rec_of[order]
    at = np.tile(np.arange(len(full)), walks)
    path = np.zeros((length, len(at)), np.int64)
    for step in range(length):
        node = node_of[r_at[at] + (rng.random(len(at)) * (r_at[at + 1] - r_at[at])).astype(np.int64)]
        path[step] = of_node[node]
        at = by_node[n_at[node] + (rng.random(len(at)) * (n_at[node + 1] - n_at[node])).astype(np.int64)]
    centre = np.concatenate([path[i] for d in range(1, window + 1) for i in range(length - d)] + [path[i + d] for d in range(1, window + 1) for i in range(length - d)])
    around = np.concatenate([path[i + d] for d in range(1, window + 1) for i in range(length - d)] + [path[i] for d in range(1, window + 1) for i in range(length - d)])
    keep = centre != around
    centre, around = centre[keep], around[keep]
    often = np.bincount(around, minlength=len(tokens)) ** 0.75
    chance = np.cumsum(often / often.sum())
    inner = (rng.random((len(tokens), dims)) - 0.5).astype(np.float32) / dims
    outer = np.zeros((len(tokens), dims), np.float32)
    # a token is met a few times in a batch, else its steps would add up before they are seen
    size = min(8192, max(16, 8 * len(tokens)))
    for epoch in range(epochs):
        shuffled = rng.permutation(len(centre))
        for k in range(0, len(shuffled), size):
            part = shuffled[k : k + size]
            c, o = centre[part], around[part]
            rate = 0.05 * (1 - (epoch + k / len(shuffled)) / epochs) + 0.001
            v = inner[c]
            pull = np.zeros_like(v)
            for j in range(negatives + 1):
                target = o if j == 0 else np.minimum(np.searchsorted(chance, rng.random(len(part))), len(tokens) - 1)
                u = outer[target]
                g = ((j == 0) - 1 / (1 + np.exp(-np.clip((v * u).sum(1), -8, 8)))).astype(np.float32)[:, None] * rate
                pull += g * u
                _add(outer, target, g * v)
            _add(inner, c, pull)
    norm = np.linalg.norm(inner, axis=1, keepdims=True)
    inner /= np.maximum(norm, 1e-9)
    return {t: inner[i].astype(np.float16) for t, i in tokens.items()}


def segment_sums(rows: np.ndarray, which: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of rows by segments: segment k adds the next size[k] of ``which``; zero for an empty one."""
    out = np.zeros((len(size), rows.shape[1]), np.float32)
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    start = (np.cumsum(size) - size)[order]
    total = np.zeros_like(out)
    for p in range(int(-falling[0]) if len(size) else 0):
        n = int(np.searchsorted(falling, -p))
        total[:n] += rows[which[start[:n] + p]]
    out[order] = total
    return out


#: Hashed tokens that have a vector of what walks meet around them.
CONTEXTS = 1 << 14


#: Rows that are gathered at once, so that they stay in the processor's cache.
GATHERED = 4096


def around(ids: np.ndarray, size: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) for each hashed token: the mean of the other tokens' rows, added over the records that hold it.
    Record k has the next size[k] of ``ids``."""
    n = np.bincount(ids, minlength=len(table))
    share = (1 / np.maximum(1, size - 1)).astype(np.float32)
    rec = np.repeat(np.arange(len(size)), size)
    # a record's whole sum for each of its tokens, less the token's own part of it
    total = segment_sums(table, ids, size) * share[:, None]
    sums = table * -np.bincount(ids, share[rec], len(table)).astype(np.float32)[:, None]
    order = np.argsort(ids, kind="stable")
    ids, rec = ids[order], rec[order]
    held = np.empty((GATHERED, table.shape[1]), np.float32)
    for k in range(0, len(ids), GATHERED):
        part = ids[k : k + GATHERED]
        rows = np.take(total, rec[k : k + GATHERED], axis=0, out=held[: len(part)], mode="clip")
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums[part[start]] += np.add.reduceat(rows, start)
    return sums, n


class Contexts:
    """Unit vectors of hashed tokens, looked up by token; ``bucket`` is the number of one."""

    def __init__(self, table: np.ndarray, bucket: Callable[[str], int]):
        self.table, self.bucket = table, bucket

    def get(self, token: str) -> np.ndarray:
        return self.table[self.bucket(token)]

    def rows(self, tokens: list[str]) -> np.ndarray:
        return self.table[np.fromiter(map(self.bucket, tokens), np.int64, len(tokens))]

    @staticmethod
    def centred(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What is met around each token less what is met around any, each row of length 1; none for tokens never met."""
        rows = sums / np.maximum(1, n)[:, None] - sums.sum(0) / max(1, n.sum())
        rows[n == 0] = 0
        return (rows / np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))).astype(np.float32)


class TokenVectors:
    """Unit vectors of tokens: hashed letter trigrams plus the trained vector, where there is one."""

    def __init__(self, trained: dict[str, np.ndarray] | Contexts, share: float = 0.35, dims: int = DIMS):
        self.trained, self.share, self.dims = trained, share, dims
        self.table = gram_table(dims)

    def of(self, tokens: list[str]) -> np.ndarray:
        """One row for each token."""
        if not tokens:
            return np.zeros((0, self.dims), np.float32)
        out = segment_sums(self.table, *grams(tokens))
        out /= np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))
        if isinstance(self.trained, Contexts):
            out += self.share * self.trained.rows(tokens).astype(np.float32)
        else:
            for k, t in enumerate(tokens):
                if (v := self.trained.get(t)) is not None:
                    out[k] += self.share * v.astype(np.float32)
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


class Kept:
    """What is made of tokens, kept for the next batches; begun anew when ``most`` tokens are held."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], most: int = 200_000):
        self.make, self.most = make, most
        self.at: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def index(self, tokens: list[str]) -> np.ndarray:
        """The rows of the tokens."""
        new = [t for t in dict.fromkeys(tokens) if t not in self.at]
        if new and len(self.at) + len(new) > self.most:
            self.at, self.rows = {}, None
            new = list(dict.fromkeys(tokens))
        if new:
            made, n = self.make(new), len(self.at)
            if self.rows is None or n + len(new) > len(self.rows):
                grown = np.zeros((2 * (n + len(new)), *made.shape[1:]), made.dtype)
                if self.rows is not None:
                    grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n : n + len(new)] = made
            self.at.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))

    def sums(self, lists: list[list[str]]) -> np.ndarray | None:
        """Unit vectors of lists of tokens, the tokens' rows added; None if there is no token at all."""
        which = self.index([t for x in lists for t in x])
        if not len(which):
            return None
        out = segment_sums(self.rows, which, np.array([len(x) for x in lists]))
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def hyperplanes(tables: int, bits: int, dims: int = DIMS, seed: int = 23) -> np.ndarray:
    """Normals of the hyperplanes: dims x (tables * bits)."""
    return np.random.default_rng(seed).standard_normal((dims, tables * bits)).astype(np.float32)


def signatures(vectors: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Vectors x tables: the side of each hyperplane that a vector lies on, as a number for each table."""
    side = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return side @ (np.int64(1) << np.arange(bits, dtype=np.int64))
