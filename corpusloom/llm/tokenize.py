"""Encoding a corpus with a public byte-level BPE vocabulary by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that a valid encoding of that prefix can end in.
A table of these last tokens is filled from left to right: a vocabulary entry that is a suffix of the prefix is the
one if it may stand after the last token of what precedes it, and two tokens may stand side by side if merging
their bytes anew gives the same two tokens. The encoding is read off backwards. Appending bytes only extends the
table, and an edit leaves the part before it as it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread

#: Fixed value: the public pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces kept per Python worker; the store is emptied when full, so it bounds memory and never a result.
KEPT_PIECES = 200_000


class PrefixEncoder:
    """Encodes pieces by the table of last tokens. ``ranks``: token bytes to id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.scan = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}

    @classmethod
    def from_bytes(cls, data: bytes, pattern: str = PATTERN) -> PrefixEncoder:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: the pair with the lowest rank merges first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def stands_alone(self, t: int) -> bool:
        ok = self.whole.get(t)
        if ok is None:
            ok = self.whole[t] = self.merge(self.bytes_of[t]) == [t]
        return ok

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Fills ``last`` (last[i]: last token of data[: i + 1]) from ``start`` to the end of ``data``."""
        del last[start:]
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - self.longest), end):
                t = self.ranks.get(data[begin:end])
                if t is not None and self.stands_alone(t) and (begin == 0 or self.may_follow(last[begin - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def read_off(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(t := last[end - 1])
            end -= len(self.bytes_of[t])
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        if (whole := self.ranks.get(data)) is not None and self.stands_alone(whole):
            return [whole]
        last: list[int] = []
        self.extend(data, last, 0)
        return self.read_off(last)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; an empty list for an empty or null one. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if text:
            known = self.pieces
            for p in self.split(text):
                ids = known.get(p)
                if ids is None:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    ids = known[p] = self.encode_piece(p)
                out += ids
        return out


class TextEncoding:
    """The encoding of one text that follows its edits: only pieces touched by an edit are encoded again."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.encoded = 0
        self.edit(0, 0, text)

    def ids(self) -> list[int]:
        return [t for last in self.tables for t in self.encoder.read_off(last)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in the place of text[start:end]."""
        # A piece is decided by what follows it up to one character, so pieces that end before the edit stay, but for the last two.
        keep = max(0, sum(s <= start for s in self.starts) - 3)
        at = self.starts[keep] if keep < len(self.starts) else len(self.text) if self.starts else 0
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        starts, tables = self.starts[:keep], self.tables[:keep]
        was = {s: k for k, s in enumerate(self.starts) if s < end}
        pos = at
        while pos < len(text):
            if pos >= start + len(new) and pos in old:  # splitting depends only on what follows: the rest is as before
                k = old[pos]
                starts += [s + shift for s in self.starts[k:]]
                tables += self.tables[k:]
                break
            m = self.encoder.scan.match(text, pos)
            data, last = m.group().encode("utf-8"), []
            if pos in was:  # an exact append or an edit behind a common prefix: the table is good that far
                k = was[pos]
                until = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
                before, same = self.text[pos:until].encode("utf-8"), 0
                for x, y in zip(before, data):
                    if x != y:
                        break
                    same += 1
                last = self.tables[k][:same]
            self.encoded += len(data) - len(last)
            self.encoder.extend(data, last, len(last))
            starts.append(pos)
            tables.append(last)
            pos = m.end()
        self.text, self.starts, self.tables = text, starts, tables


_encoders: dict[int, PrefixEncoder] = {}


def _encoder(data: bytes) -> PrefixEncoder:
    """One encoder per Python worker and vocabulary."""
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PrefixEncoder.from_bytes(data)
    return _encoders[key]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(id, ids): the token ids of every row's text, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded like any other; repeated rows give repeated
    rows; an empty table gives an empty one; other columns are not read. Whole texts are encoded, of any length.
    The vocabulary (under 1 MB) is read on the driver and broadcast.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for b in batches:
            flat, ends = [], [0]
            chunks = []
            for t in b.column(1).to_pylist():
                ids = encode(t)
                flat += ids
                ends.append(ends[-1] + len(ids))
                if len(flat) > 1_000_000:
                    chunks.append(np.array(flat, np.int32))
                    flat = []
            values = np.concatenate([*chunks, np.array(flat, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    out = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")))
    return out.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """The columns ``keep`` and n_tokens BIGINT, the length of each text's encoding (0 for null and empty)."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    out = spread(df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text")))
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return out.mapInArrow(run, f"{kept}, n_tokens bigint")
