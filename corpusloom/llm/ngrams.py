"""Similarity join of strings: weighted character n-grams, prefix-filtered inverted index, cosine.

Only strings of one block are compared. A small block is one matrix, whose products with itself are all its cosines. In
a larger one a string's n-grams are ordered from rare to common; those before the point where the rest's weight falls
below the threshold form its prefix. Two strings whose cosine reaches the threshold share an n-gram of both prefixes, so
the index holds prefixes only and loses no pair. Where an exact check decides below a higher threshold, prefixes are those
of the higher one, and what the check may accept meets under keys of its own.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

#: n-grams are hashed to so many numbers, which bounds the table of their frequencies.
BUCKETS = 1 << 16
#: Vectors that a task keeps for the next pairs before it begins anew.
MOST_KEPT = 100_000
#: Strings of a block that are compared by one product of matrices; a larger block goes through the index.
SMALL_BLOCK = 256


@functools.lru_cache(1 << 17)
def _bucket(gram: str) -> int:
    h = 2166136261
    for c in gram:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 16) & (BUCKETS - 1)


def grams_of(s: str, n: int = 3) -> Counter:
    """Hashed n-grams of a string with an edge mark on either side. With n = 0 its letters, each twice, its pairs of
    neighbours and its pairs with one letter between: of these an exchange of neighbours leaves most."""
    p = f"\x02{s}\x03"
    out: Counter = Counter()
    if n:
        for i in range(max(1, len(p) - n + 1)):
            out[_bucket(p[i : i + n])] += 1
        return out
    for c in s:
        out[_bucket(c)] += 2
    for i in range(len(p) - 1):
        out[_bucket(p[i : i + 2])] += 1
        if i < len(p) - 2:
            out[_bucket(f"{p[i]}\x04{p[i + 2]}")] += 1
    return out


def gram_weights(strings: DataFrame, col: str = "s", n: int = 3) -> np.ndarray:
    """Inverse document frequency of every hashed n-gram over all strings; at most BUCKETS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                df[list(grams_of(s, n))] += 1
                df[BUCKETS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["g", "n"])

    rows = strings.select(col).mapInArrow(count, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[rows["g"].to_numpy(int)] = rows["n"].to_numpy(float)
    return np.log1p(df[BUCKETS] / np.maximum(1, df[:BUCKETS])).astype(np.float32)


def weighted(s: str, weights: np.ndarray, n: int = 3) -> dict[int, float]:
    """The string's n-grams with their weights, the vector being of length 1."""
    v = {g: c * float(weights[g]) for g, c in grams_of(s, n).items()}
    norm = sum(x * x for x in v.values()) ** 0.5 or 1.0
    return {g: x / norm for g, x in v.items()}


def prefix(v: dict[int, float], weights: np.ndarray, least: float) -> list[int]:
    """The rarest n-grams of a vector, up to where the rest cannot reach the threshold with any vector of length 1."""
    rest, out = sum(x * x for x in v.values()), []
    for g in sorted(v, key=lambda g: (-weights[g], g)):
        if rest**0.5 < least - 1e-6:
            break
        out.append(g)
        rest = max(0.0, rest - v[g] ** 2)
    return out


def cosine(a: dict[int, float], b: dict[int, float]) -> float:
    return sum(x * b[g] for g, x in a.items() if g in b)


def index_keys(s: str, weights: np.ndarray, least: float, n: int, sure: float, near: Callable[[str], set[int]] | None) -> list[int]:
    """Under what a string is held in the index: two that ``similar_pairs`` accepts have one of these in common."""
    v = weighted(s, weights, n)
    return prefix(v, weights, least) if near is None else [*prefix(v, weights, sure), *(BUCKETS + k for k in near(s))]


def near_in_block(vectors: list[dict[int, float]], least: float) -> list[tuple[int, int]]:
    """Pairs of a block's vectors whose cosine may reach ``least``, but for rounding."""
    if len(vectors) == 2:
        return [(0, 1)]
    at = {g: k for k, g in enumerate(dict.fromkeys([g for v in vectors for g in v]))}
    rows = np.zeros((len(vectors), len(at)), np.float32)
    rows[np.repeat(np.arange(len(vectors)), [len(v) for v in vectors]), [at[g] for v in vectors for g in v]] = [x for v in vectors for x in v.values()]
    return np.argwhere(np.triu(rows @ rows.T, 1) >= least - 1e-3).tolist()


def similar_pairs(
    strings: DataFrame, verify: Callable[[str, str], bool], least: float = 0.5, n: int = 3, sure: float = 1.0, near: Callable[[str], set[int]] | None = None, small: int = SMALL_BLOCK
) -> DataFrame:
    """(block, a, b, cosine), a < b: pairs of distinct strings ``s`` of one ``block`` whose cosine is at least ``sure``, or
    at least ``least`` while ``verify`` accepts them. ``strings``: distinct (block, s). Null strings or blocks match nothing.
    ``near``: keys of a string, of which two that ``verify`` accepts share one."""
    strings = strings.select("block", "s").filter("block is not null and s is not null and s != ''")
    strings = cut(strings.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("block"))))
    sc = strings.sparkSession.sparkContext
    shared = sc.broadcast(gram_weights(strings, "s", n))
    schema = "block string, a string, b string, cosine double"

    def accepted(a: str, b: str, c: float) -> bool:
        return c >= least - 1e-6 and (c >= sure - 1e-6 or verify(a, b))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            out = []
            for block, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names = sorted(names)
                made = [weighted(s, w, n) for s in names]
                for i, j in near_in_block(made, least):
                    c = cosine(made[i], made[j])
                    if accepted(names[i], names[j], c):
                        out.append((block, names[i], names[j], c))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.string(), pa.string(), pa.float64()))], names=["block", "a", "b", "cosine"])

    few = strings.filter(F.col("of").between(2, small)).groupBy("block").agg(F.collect_list("s").alias("names")).mapInArrow(compare, schema)
    if strings.filter(F.col("of") > small).limit(1).count() == 0:
        return few

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            block, grams, text = [], [], []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = index_keys(s, w, least, n, sure, near)
                block += [k] * len(p)
                text += [s] * len(p)
                grams += p
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.string()), pa.array(grams, pa.int64()), pa.array(text, pa.string())], names=["block", "g", "s"])

    postings = strings.filter(F.col("of") > small).select("block", "s").mapInArrow(index, "block string, g bigint, s string")
    left, right = postings.withColumnRenamed("s", "a"), postings.withColumnRenamed("s", "b")
    pairs = left.join(right, ["block", "g"]).filter("a < b").select("block", "a", "b").distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, made = shared.value, {}
        for pdf in batches:
            if len(made) > MOST_KEPT:
                made = {}
            made |= {s: weighted(s, w, n) for s in dict.fromkeys([*pdf["a"], *pdf["b"]]) if s not in made}
            pdf = pdf.assign(cosine=np.array([cosine(made[a], made[b]) for a, b in zip(pdf["a"], pdf["b"])], float))
            yield pdf[[accepted(*x) for x in zip(pdf["a"], pdf["b"], pdf["cosine"])]]

    return few.unionAll(pairs.mapInPandas(check, schema))
