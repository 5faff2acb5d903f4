"""Languages of documents and of their segments by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, the first
rotated twice and the second once; a text is the sum of its trigrams, and a language the weighted sum of the trigrams
of the texts labelled with it. Texts are compared with the languages by cosine. The product of a text with a language
is the sum of the products of its trigrams, so each trigram's product with each language is computed once and words
only add up table entries. Segments come from the best path over the words, where a change of language has a price
that is lower between sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.langcodes import label_code
from corpusloom.session import spread

LANGS = ("de", "en", "es", "fr", "it", "pt")
#: Fixed value: letters of the six languages; a trigram is three of 64 signs, the first being a word's edge.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäæçèéêëìíîïñòóôõöœùúûüÿß"
DIMENSIONS = 16384
#: Trigrams of words that a text needs before it counts as text in a language, and words a segment needs.
LEAST_WORDS = 4
SWITCH_AT_SENTENCE, SWITCH_INSIDE = 9.0, 22.0

_codes = np.zeros(0x10000, np.int32)
for _i, _c in enumerate(LETTERS):
    _codes[ord(_c)] = _i + 1
_SENTENCE = 63

_noise = regex.compile(
    r"<[^<>]{0,200}>|&\w+;|https?://\S*|\bwww\.\S+|\b10\.\d{4,}/\S+|\S+@\S+"  # markup and addresses
    r"|«[^»]{0,200}»|“[^”]{0,200}”|„[^“”]{0,200}[“”]|\"[^\"]{0,200}\""  # quoted terms
    r"|\(\s*(?:\p{Lu}[\p{L}'’.-]*[\s,;&]+)+(?:et al\.?,?\s*)?\d{4}[a-z]?\s*\)|\([^()]{0,12}[=<>][^()]{0,40}\)"  # names with a year, figures
    r"|\b\p{L}{1,2}-?\d[\p{L}\d-]*"  # codes
)
_heading = regex.compile(r"(?:(?<=^|[.!?\n|/\]-]\s*))\p{L}+(?:[ -]\p{L}+)?\s?:")
_ends = regex.compile(r"[.!?…]+(?=\s|$)|\n|\s[|/]\s|--+|\[(?:\.\.\.|…)\]|[  ]")


def clean(text: str | None) -> str:
    """The text without markup, quoted terms, codes, names with a year and headings; sentence ends become \\x01."""
    if not text:
        return ""
    return _ends.sub(" \x01 ", _heading.sub(" \x01 ", _noise.sub(" ", text))).lower()


class Words:
    """Trigrams of many texts: gram ids, the word of each gram, the text of each word, and whether a sentence begins with it."""

    def __init__(self, texts: list[str | None]):
        joined = "\x02".join([clean(t) for t in texts]) + "\x02"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        codes = np.where(points < 0x10000, _codes[np.minimum(points, 0xFFFF)], 0)
        text_no = np.cumsum(points == 2) - (points == 2)
        sentence_no = np.cumsum((points == 1) | (points == 2))
        letter = codes > 0
        starts = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
        ends = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
        long = ends - starts >= 1
        starts, ends = starts[long], ends[long]
        self.text, sentence = text_no[starts], sentence_no[starts]
        self.first = np.r_[True, sentence[1:] != sentence[:-1]] if len(starts) else np.zeros(0, bool)
        padded = np.r_[0, codes, 0]
        inside = np.zeros(len(codes) + 1, np.int32)
        inside[starts] += 1
        inside[ends] -= 1
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        self.grams = padded[at] * 4096 + padded[at + 1] * 64 + padded[at + 2]
        self.word = np.repeat(np.arange(len(starts)), ends - starts)
        self.begin = np.r_[0, np.cumsum(ends - starts)[:-1]] if len(starts) else np.zeros(0, np.int64)
        self.n_texts = len(texts)

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Words x languages: the sums of the table's entries over each word's grams."""
        if not len(self.begin):
            return np.zeros((0, table.shape[1]), np.float32)
        return np.add.reduceat(table[self.grams], self.begin, axis=0)


def gram_vectors(grams: np.ndarray, dims: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    """The vectors of trigrams: letters' vectors bound in their permuted order."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (64, dims))
    return np.roll(letters, 2, 1)[grams // 4096] * np.roll(letters, 1, 1)[grams // 64 % 64] * letters[grams % 64]


def profile_table(counts: np.ndarray, dims: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    """Grams x languages: each gram's product with each language's prototype.

    ``counts``: languages x 64^3. A language's trigrams are bundled with the root of their relative frequency, less
    the mean over the languages, so that what all languages share adds nothing.
    """
    known = np.flatnonzero(counts.sum(0))
    weights = np.sqrt(counts[:, known] / np.maximum(1, counts.sum(1, keepdims=True)))
    weights -= weights.mean(0)
    protos = np.zeros((len(counts), dims), np.float32)
    for k in range(0, len(known), 512):
        protos += weights[:, k : k + 512].astype(np.float32) @ gram_vectors(known[k : k + 512], dims, seed).astype(np.float32)
    protos /= np.maximum(1e-9, np.linalg.norm(protos, axis=1, keepdims=True))
    table = np.zeros((64**3, len(counts)), np.float32)
    for k in range(0, len(known), 512):
        table[known[k : k + 512]] = gram_vectors(known[k : k + 512], dims, seed).astype(np.float32) @ protos.T
    return table / np.float32(np.sqrt(dims))


def best_path(scores: np.ndarray, text: np.ndarray, first: np.ndarray, n_texts: int) -> np.ndarray:
    """The language of each word: the path of the highest sum of scores less the prices of changes, for all texts at once."""
    out = np.zeros(len(scores), np.int8)
    lengths = np.bincount(text, minlength=n_texts)
    offsets = np.r_[0, np.cumsum(lengths)]
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    k = 0
    while k < len(order):
        # texts of like length go together; one step takes one word of each
        many = k + 1
        while many < len(order) and (many + 1 - k) * lengths[order[many]] <= 400_000 and lengths[order[many]] <= 2 * lengths[order[k]] + 16:
            many += 1
        ids, k = order[k:many], many
        size, start = lengths[ids], offsets[ids]
        steps = int(size.max())
        best = np.zeros((len(ids), scores.shape[1]), np.float32)
        stay = np.zeros((steps, len(ids), scores.shape[1]), bool)
        come = np.zeros((steps, len(ids)), np.int8)
        for t in range(steps):
            live = t < size
            at = np.minimum(start + t, len(scores) - 1)
            top = best.argmax(1)
            leave = best.max(1) - np.where(first[at], SWITCH_AT_SENTENCE, SWITCH_INSIDE).astype(np.float32)
            if t == 0:
                leave[:] = 0
            keep = best >= leave[:, None]
            stay[t], come[t] = keep, top
            new = np.where(keep, best, leave[:, None]) + scores[at]
            best = np.where(live[:, None], new, best)
        state = best.argmax(1)
        rows = np.arange(len(ids))
        for t in range(steps - 1, -1, -1):
            live = t < size
            out[(start + t)[live]] = state[live]
            move = live & ~stay[t][rows, state]
            state = np.where(move, come[t], state)
    return out


def segments_of(texts: list[str | None], table: np.ndarray, scale: float) -> list[list[tuple[str, float, int]]]:
    """For each text its segments: (language, confidence, words). None for a text without enough text in a language."""
    words = Words(texts)
    scores = words.scores(table) * np.float32(scale)
    path = best_path(scores, words.text, words.first, words.n_texts)
    out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
    if not len(path):
        return out
    runs = np.flatnonzero(np.r_[True, (words.text[1:] != words.text[:-1]) | (path[1:] != path[:-1])])
    sums = np.add.reduceat(scores, runs, axis=0)
    size = np.diff(np.r_[runs, len(path)])
    for k, r in enumerate(runs):
        segs = out[words.text[r]]
        if size[k] < LEAST_WORDS:
            continue
        s = sums[k].astype(float)
        lang = int(path[r])
        p = float(1 / np.exp(np.minimum(60, (s - s[lang]) / np.sqrt(size[k]))).sum())
        # a text in no language at all comes out equally far from all of them
        if s[lang] / size[k] < 0.35:
            continue
        if segs and segs[-1][0] == LANGS[lang]:
            a, q, n = segs[-1]
            segs[-1] = (a, (q * n + p * int(size[k])) / (n + int(size[k])), n + int(size[k]))
        else:
            segs.append((LANGS[lang], p, int(size[k])))
    return out


def _count(df: DataFrame, label: str, table: np.ndarray | None, scale: float) -> np.ndarray:
    """Languages x 64^3 counts of trigrams, under the labels as delivered or, with a table, under those it gives."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((table, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LANGS), 64**3), np.int64)
        table, scale = shared.value
        for b in batches:
            words = Words(b.column(0).to_pylist())
            if table is None:
                of = np.array([LANGS.index(x) if x in LANGS else -1 for x in b.column(1).to_pylist()], np.int64)[words.text] if len(words.text) else np.zeros(0, np.int64)
            else:
                of = best_path(words.scores(table) * np.float32(scale), words.text, words.first, words.n_texts).astype(np.int64)
            lang = of[words.word]
            ok = lang >= 0
            total += np.bincount(lang[ok] * 64**3 + words.grams[ok], minlength=total.size).reshape(total.shape)
        lang, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(gram, pa.int32()), pa.array(total[lang, gram], pa.int64())], names=["lang", "gram", "n"])

    rows = df.select("__text", label).mapInArrow(run, "lang int, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(LANGS), 64**3))  # at most 6 * 64^3 rows, whatever the corpus
    counts[rows["lang"].to_numpy(int), rows["gram"].to_numpy(int)] = rows["n"].to_numpy(float)
    return counts


def _scale(counts: np.ndarray, table: np.ndarray) -> float:
    """Makes the mean lead of the right language over the next one 1 a trigram, so that prices mean the same on all data."""
    lead = []
    for k in range(len(counts)):
        others = np.delete(table, k, 1)
        w = counts[k] / max(1, counts[k].sum())
        if counts[k].sum():
            lead.append(((table[:, k : k + 1] - others) * w[:, None]).sum(0).min())
    return float(0.6 / max(1e-9, np.mean(lead))) if lead else 1.0


def fit_profiles(df: DataFrame, text_col: str = "value", label_col: str = "lang") -> tuple[np.ndarray, float]:
    """The trigram table and its scale, from all labelled rows, then once more from all rows under the labels found,
    which takes out wrong labels and texts in several languages."""
    src = spread(df.select(F.col(text_col).cast("string").alias("__text"), label_code(F.col(label_col)).alias("__label")))
    counts = _count(src, "__label", None, 1.0)
    table = profile_table(counts)
    scale = _scale(counts, table)
    counts = _count(src, "__label", table, scale)
    table = profile_table(counts)
    return table, _scale(counts, table)


def detect_segments(df: DataFrame, profiles: tuple[np.ndarray, float], id_col: str = "id", text_col: str = "value", label_col: str = "lang") -> DataFrame:
    """(id, label, segs): for each row its label's code and its segments (lang, confidence, n_words) in text order.

    Null, empty and blank values and values without text in a language have no segments. Texts of any length are read
    whole. Repeated rows give repeated rows. The profiles (6 x 64^3 numbers) are broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    id_type = df.schema[id_col].dataType.simpleString()
    seg = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scale = shared.value
        for b in batches:
            found = segments_of(b.column(2).to_pylist(), table, scale)
            segs = pa.array([[{"lang": x, "confidence": p, "n_words": n} for x, p, n in s] for s in found], pa.list_(seg))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), segs], names=[id_col, "label", "segs"])

    src = spread(df.select(F.col(id_col), label_code(F.col(label_col)).alias("label"), F.col(text_col).cast("string").alias("__text")))
    return src.mapInArrow(run, f"`{id_col}` {id_type}, label string, segs array<struct<lang:string,confidence:double,n_words:int>>")


def language_cases(segments: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, seg, lang, confidence, n_words) of rows whose label is missing or wrong, or whose text has several languages."""
    wrong = (F.size("segs") > 1) | ((F.size("segs") == 1) & ~F.col("label").eqNullSafe(F.col("segs")[0]["lang"]))
    rows = segments.filter(wrong).select(id_col, F.posexplode("segs").alias("seg", "s"))
    return rows.select(id_col, "seg", "s.lang", "s.confidence", "s.n_words").dropDuplicates([id_col, "seg"])
