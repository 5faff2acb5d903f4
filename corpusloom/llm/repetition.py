"""Repetition inside a document, decided by a short-circuit cascade.

A document is repetitive if at least ``share`` of its words stand in passages of ``passage`` or more words that
already stood earlier in it. Every rule of the cascade is a proof that a document cannot be: a word in a repeated
passage is itself a repeat, so the distinct words cannot exceed the rest; a repeated passage of length n holds
n - 1 repeated pairs and n - 2 repeated triples, so the same holds of these in proportion. Whatever no rule rejects
gets the exact measure, so the order of the rules changes the cost and never a result. The order is set by
rejections per second as measured on the first documents of each task.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread

_words = regex.compile(r"\p{L}+").findall
#: Documents of each task on which all rules are timed before they are put in order.
SAMPLE = 200


def words_of(text: str | None) -> list[str]:
    """Runs of letters of the composed text, in lower case."""
    if not text:
        return []
    return [w.lower() for w in _words(text if text.isascii() else unicodedata.normalize("NFC", text))]


def repeated_words(words: list[str], passage: int) -> int:
    """How many words stand in passages of ``passage`` words or more that already stood earlier."""
    seen, covered, until = set(), 0, 0
    for i, gram in enumerate(zip(*(words[k:] for k in range(passage)))):
        if gram in seen:
            covered += i + passage - max(until, i)
            until = i + passage
        else:
            seen.add(gram)
    return covered


def rules(share: float, passage: int) -> dict[str, Callable[[list[str]], bool]]:
    """Rules that are true of a document only if it cannot be repetitive."""

    def short(w: list[str]) -> bool:
        return len(w) <= passage

    def distinct(n: int) -> Callable[[list[str]], bool]:
        part = share * (passage - n + 1) / passage

        def rule(w: list[str]) -> bool:
            grams = len(w) - n + 1
            # of at least share * words covered words, in runs of at least `passage`, so many n-grams are repeats
            return grams < 1 or grams - len(set(w) if n == 1 else set(zip(*(w[k:] for k in range(n))))) < part * len(w) - 1e-9

        return rule

    return {"short": short, "distinct_words": distinct(1), "distinct_pairs": distinct(2), "distinct_triples": distinct(3)}


class Cascade:
    """Applies the rules in the order of rejections per second; the order is measured, the outcome isn't changed by it."""

    def __init__(self, share: float, passage: int, sample: int = SAMPLE):
        self.share, self.passage, self.sample = share, passage, sample
        self.rules = rules(share, passage)
        self.cost = dict.fromkeys(self.rules, 1e-9)
        self.rejected = dict.fromkeys(self.rules, 0)
        self.seen = 0
        self.order = list(self.rules)

    def decide(self, words: list[str]) -> tuple[bool, str]:
        """Whether the document is repetitive, and the rule that decided."""
        if self.seen < self.sample:
            self.seen += 1
            hit = ""
            for name, rule in self.rules.items():
                t = time.perf_counter()
                no = rule(words)
                self.cost[name] += time.perf_counter() - t
                self.rejected[name] += no
                hit = hit or (no and name) or ""
            if self.seen == self.sample:
                self.order.sort(key=lambda n: -self.rejected[n] / self.cost[n])
            if hit:
                return False, hit
        else:
            for name in self.order:
                if self.rules[name](words):
                    return False, name
        return self.is_repetitive(words), "measured"

    def is_repetitive(self, words: list[str]) -> bool:
        return bool(words) and repeated_words(words, self.passage) >= self.share * len(words)


def find_repetitive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.25, passage: int = 5) -> DataFrame:
    """(id): the documents of which at least ``share`` of the words are repeated, by the cascade.

    Null, empty and blank texts and texts without letters have no words and are never repetitive. Repeated rows with
    one id give one row. Texts of any length are read whole, in time linear in their words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(share, passage)
        for b in batches:
            keep = [cascade.decide(words_of(t))[0] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=[id_col])

    src = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")))
    return src.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}").distinct()


def measure_repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = 5) -> DataFrame:
    """(id, n_words, n_repeated, share): the exact measure of every document; share is 0 for one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = [], []
            for t in b.column(1).to_pylist():
                w = words_of(t)
                n.append(len(w))
                r.append(repeated_words(w, passage))
            share = [y / x if x else 0.0 for x, y in zip(n, r)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(share, pa.float64())], names=[id_col, "n_words", "n_repeated", "share"])

    src = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")))
    return src.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words bigint, n_repeated bigint, share double")


_sentence_ends, _line_ends = regex.compile(r"[.!?\n]+"), regex.compile(r"\n+")


def repeated_units(pieces: list[str]) -> tuple[int, int]:
    """(units, repeated): pieces with words, and those of them whose words already stood in an earlier one."""
    keys = [" ".join(w) for w in map(words_of, pieces) if w]
    return len(keys), len(keys) - len(set(keys))


def measure_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, repeated_sentences, n_paragraphs, repeated_paragraphs): whole sentences and lines that repeat
    earlier ones of their text but for case, punctuation and figures. Texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = [(*repeated_units(_sentence_ends.split(t)), *repeated_units(_line_ends.split(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]], names=[id_col, "n_sentences", "repeated_sentences", "n_paragraphs", "repeated_paragraphs"])

    src = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")))
    return src.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_sentences bigint, repeated_sentences bigint, n_paragraphs bigint, repeated_paragraphs bigint")
