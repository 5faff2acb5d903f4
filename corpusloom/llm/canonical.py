"""Mapping of freely typed values to the entries of a reference list by a BK-tree under the edit distance.

Every child of a node is filed under its distance from the node, so the triangle inequality leaves only the children
filed between d - r and d + r to visit; what is visited contains every entry within r. The tree is broadcast while the
list has a checked size; a larger list is cut into shards, whose trees are broadcast one after the other, and the shards'
winners merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.text import NearWords, Patterns, Signs, banded, distances, pack, plain, with_swaps
from corpusloom.session import cut, spread

#: Spellings of a list whose tree is broadcast (about 500 bytes each), and of one shard of a larger list.
MOST_BROADCAST = 200_000
#: Pairs of a query and a node that are compared in one step, few enough for the processor's cache.
STEP = 1 << 15


class BKTree:
    """A tree over distinct strings of at most 64 signs."""

    def __init__(self, keys: list[str]):
        self.keys = list(dict.fromkeys(k for k in keys if 0 < len(k) <= 64))
        self.long = list(dict.fromkeys(k for k in keys if len(k) > 64))
        self.where = {k: i for i, k in enumerate(self.keys)}
        self.signs = Signs()
        self.packed = Patterns(self.keys, self.signs)
        self._grow()

    def _grow(self) -> None:
        """Builds level by level: what hangs below a node is compared with it at once and split by distance."""
        edges = []
        todo = [(0, np.arange(1, len(self.keys)))] if self.keys else []
        while todo:
            below = []
            for node, rest in todo:
                if not len(rest):
                    continue
                d = distances(self.packed, np.full(len(rest), node), self.packed.codes, self.packed.size, rest)
                for x in np.unique(d):
                    group = rest[d == x]
                    edges.append((node * 256 + int(x), int(group[0])))
                    below.append((int(group[0]), group[1:]))
            todo = below
        edges.sort()
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([c for _, c in edges], np.int64)

    def search(self, queries: list[str], radius: list[int]) -> list[list[tuple[str, int]]]:
        """For each query every key within its radius, with the distance."""
        out: list[list[tuple[str, int]]] = [[] for _ in queries]
        short = sorted((k for k, q in enumerate(queries) if 0 < len(q) <= 64), key=lambda k: len(queries[k]))
        for k, q in enumerate(queries):
            for key in self.long if len(q) <= 64 else [*self.long, *self.keys]:
                if (d := banded(q, key, radius[k])) <= radius[k]:
                    out[k].append((key, d))
        if not self.keys or not short:
            return out
        codes, length = pack([queries[k] for k in short], self.signs)
        r = np.array([radius[k] for k in short], np.int64)
        stack = [(np.arange(len(short)), np.zeros(len(short), np.int64))]
        while stack:
            q, n = stack.pop()
            if len(q) > STEP:
                stack += [(q[STEP:], n[STEP:])]
                q, n = q[:STEP], n[:STEP]
            d = distances(self.packed, n, codes, length, q)
            for x in np.flatnonzero(d <= r[q]):
                out[short[q[x]]].append((self.keys[n[x]], int(d[x])))
            lo = np.searchsorted(self.edge, n * 256 + np.maximum(0, d - r[q]))
            hi = np.searchsorted(self.edge, n * 256 + np.minimum(255, d + r[q]), "right")
            many = hi - lo
            if total := int(many.sum()):
                at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                stack.append((np.repeat(q, many), self.child[at]))
        return out


#: Words put before or after a place's name, and shortened first words of names.
BEFORE = ("near", "greater", "city of", "ville de", "region de", "stadt")
AFTER = ("city",)
SHORT_WORDS = {
    "st": ("saint", "sankt", "san", "santo"), "ste": ("sainte",), "sta": ("santa",), "mt": ("mount", "mont", "monte"), "ft": ("fort",),
    "s": ("san", "saint"), "gr": ("gross", "great", "grand", "grande"), "upr": ("upper",), "pto": ("puerto", "porto"), "pt": ("port",), "cast": ("castel",),
}
_parts = regex.compile(r"[,;()\[\]/]| [-–] ")
_slash_sea = regex.compile(r"(?<=\w)\s*/\s*(?=\w)|\bs/")


class Reader:
    """Reads typed values: spellings to look up, best first, and the group (country) that a value names."""

    def __init__(self, groups: dict[str, str]):
        self.groups = groups
        self.near = NearWords([(name, min(2, len(name) // 5)) for name in groups if len(name) >= 6])
        self.by_length = sorted(groups.items(), key=lambda x: -len(x[0]))

    def group_of(self, part: str) -> str | None:
        if part in self.groups:
            return self.groups[part]
        at = self.near.find(part) if len(part) >= 6 else -1
        return self.groups[self.near.words[at][0]] if at >= 0 else None

    def in_context(self, context: str | None, value: str) -> str | None:
        if not context:
            return None
        rest = f" {plain(context.replace(value, ' , '))} "
        for name, code in self.by_length:
            if len(name) > 3 and f" {name} " in rest:
                return code
        return None

    def strip(self, key: str) -> tuple[str, str | None]:
        """The key without postal codes and words that only introduce a name, and the group its end names."""
        group = None
        words = [w for w in key.split() if not (w.isdigit() and len(w) >= 4)]
        changed = True
        while changed and len(words) > 1:
            changed = False
            for n in (3, 2, 1):
                if len(words) > n and (g := self.groups.get(" ".join(words[-n:]))):
                    words, group, changed = words[:-n], g, True
                    break
            if len(words) > 2 and words[-1].isdigit() and len(words[-1]) <= 2 and banded(words[-2], "cedex", 1) <= 1:
                words, changed = words[:-2], True
            elif len(words) > 1 and banded(words[-1], "cedex", 1) <= 1:
                words, changed = words[:-1], True
            elif len(words) > 1 and any(banded(words[-1], a, 1) <= 1 for a in AFTER):
                words, changed = words[:-1], True
            for b in BEFORE:
                n = b.count(" ") + 1
                if len(words) > n and banded(" ".join(words[:n]), b, 1) <= 1:
                    words, changed = words[n:], True
                    break
        return " ".join(words), group

    def read(self, value: str) -> tuple[list[str], str | None]:
        group = None
        whole = plain(value)
        parts = [p for p in map(plain, _parts.split(value)) if p]
        kept = []
        for k, p in enumerate(parts):
            g = self.group_of(p) if len(parts) > 1 and (k or len(parts) == 2 and p in self.groups) else None
            if g:
                group = group or g
            else:
                kept.append(p)
        spellings = []
        for p in dict.fromkeys([" ".join(kept), *kept[:1], whole, plain(_slash_sea.sub(" sur ", value))]):
            bare, g = self.strip(p)
            group = group or g
            spellings += [bare, p]
        for p in list(spellings):
            head, _, rest = p.partition(" ")
            spellings += [f"{w} {rest}" for w in SHORT_WORDS.get(head, ()) if rest]
        return [s for s in dict.fromkeys(spellings) if s], group


#: The rank of a hit that is no exact one.
NOT_EXACT = 1 << 20


def radius_of(key: str) -> int:
    """How far off an entry may be: 2 up to eight signs, then 3. Up to five signs both faults must be one exchange of neighbours."""
    return 0 if len(key) < 4 else 2 if len(key) < 9 else 3


def near_enough(key: str, entry: str, d: int) -> int | None:
    """The distance, an exchange of neighbours counting once, if it is small enough for a value of this length."""
    far = d if d <= 1 else with_swaps(key, entry)
    return far if far <= (1 if len(key) < 6 else 2) else None


class Aligner:
    """Looks up values. ``entries``: key, entry id, group, weight; a heavier entry is the likelier one among equals."""

    def __init__(self, entries: pd.DataFrame, reader: Reader):
        self.tree, self.reader = BKTree(entries["key"].tolist()), reader
        self.entries: dict[str, list[tuple[int, str, float]]] = {}
        for k, i, g, w in zip(entries["key"], entries["entry"], entries["grp"], entries["weight"]):
            self.entries.setdefault(k, []).append((i, g, w))

    def choose(self, found: list[tuple[str, int]], group: str | None) -> tuple[float, int, str] | None:
        """The best entry: nearest, then heaviest, then lowest id; of the named group if one is named."""
        best = None
        for key, d in found:
            for i, g, w in self.entries.get(key, ()):
                if (group is None or g == group) and (best is None or (d, -w, i) < best[0]):
                    best = ((d, -w, i), key)
        return None if best is None else (best[0][0], best[0][2], best[1])

    def align(self, values: list[tuple[str, str | None, str | None]]) -> list[tuple[int, int, float, float, int] | None]:
        """For each (value, group, context): entry id, distance, confidence, the entry's weight and the rank of the spelling
        that hit exactly, or None. An exact hit of an earlier spelling wins, then the nearest, heaviest entry."""
        out: list[tuple[int, int, float, float, int] | None] = [None] * len(values)
        todo: dict[str, list[tuple[int, str | None]]] = {}
        for k, (value, group, context) in enumerate(values):
            spellings, named = self.reader.read(value)
            group = named or group or self.reader.in_context(context, value)
            hit = None
            for rank, s in enumerate(spellings):
                if s in self.entries and (hit := self.choose([(s, 0)], group)):
                    out[k] = (hit[1], 0, 1.0, max(w for i, _, w in self.entries[s] if i == hit[1]), rank)
                    break
            if hit is None:
                for s in spellings:
                    todo.setdefault(s, []).append((k, group))
        queries = list(todo)
        for s, found in zip(queries, self.tree.search(queries, [radius_of(s) for s in queries])):
            near = [(key, d2) for key, d in found if (d2 := near_enough(s, key, d)) is not None]
            for k, group in todo[s]:
                if hit := self.choose(near, group):
                    new = (hit[1], int(hit[0]), 1 - hit[0] / max(len(s), len(hit[2])), max(w for i, _, w in self.entries[hit[2]] if i == hit[1]), NOT_EXACT)
                    old = out[k]
                    if old is None or (new[1], -new[3], new[0]) < (old[1], -old[3], old[0]):
                        out[k] = new
        return out


def list_entries(rows: DataFrame, id_col: str, name_cols: list[str], names_col: str | None, group_col: str, weight_col: str) -> DataFrame:
    """(key, entry, grp, weight): one row for each distinct spelling of each entry; names_col is comma-separated."""
    names = F.array(*[F.col(c) for c in name_cols])
    if names_col:
        names = F.concat(names, F.coalesce(F.split(names_col, ","), F.array().cast("array<string>")))
    key = F.pandas_udf(lambda s: s.map(plain), "string")
    out = rows.select(F.col(id_col).alias("entry"), F.col(group_col).alias("grp"), F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)).alias("weight"), F.explode(names).alias("name"))
    return out.filter("name is not null").select(key("name").alias("key"), "entry", "grp", "weight").filter("key != ''").distinct()


def group_names(rows: DataFrame, code_col: str, name_cols: list[str]) -> dict[str, str]:
    """Folded names and codes of groups; the driver holds at most ten thousand."""
    held = rows.select(code_col, *name_cols).limit(10_001).collect()
    if len(held) > 10_000:
        raise ValueError("more groups than the driver may hold")
    return {plain(n): r[0] for r in held for n in r if n}


def align_values(
    mentions: DataFrame,
    entries: DataFrame,
    groups: dict[str, str],
    id_col: str = "mention_id",
    value_col: str = "name",
    group_col: str | None = "country_code",
    context_col: str | None = "context",
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """(id, entry, distance, confidence): for each mention with a value the entry it means, or -1 with nulls.

    Mentions with a null or blank value give no row; a mention delivered twice gives one. Of equally near entries the
    heaviest, then the one with the lowest id is taken; where a group is named by the value, its column or its
    context, only entries of it count. Values of any length are compared whole. Empty tables give empty results, or
    -1 for every value where only the list is empty.
    """
    null = F.lit(None).cast("string")
    src = mentions.select(
        F.col(id_col).alias("id"), F.col(value_col).cast("string").alias("value"),
        (F.upper(F.trim(F.col(group_col))) if group_col else null).alias("grp"), (F.col(context_col) if context_col else null).alias("context"),
    ).filter("trim(value) != '' and length(regexp_replace(value, '\\\\s', '')) > 0")
    known = F.col("grp").isin(sorted(set(groups.values()))) if groups else F.lit(False)
    src = src.withColumn("grp", F.when(known, F.col("grp")))
    id_type = mentions.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, entry bigint, distance int, confidence double, weight double, rank int"
    sc = mentions.sparkSession.sparkContext

    def rows_of(aligner: Aligner, pdf: pd.DataFrame) -> pd.DataFrame:
        values = list(zip(pdf["value"], pdf["grp"].where(pdf["grp"].notna(), None), pdf["context"].where(pdf["context"].notna(), None)))
        places = {v: k for k, v in enumerate(dict.fromkeys(values))}
        found = aligner.align(list(places))
        hits = [found[places[v]] or (-1, None, None, None, None) for v in values]
        ints = {c: pd.array([h[k] for h in hits], "Int32") for c, k in (("distance", 1), ("rank", 4))}
        return pd.DataFrame({"id": pdf["id"], "entry": [h[0] for h in hits], "distance": ints["distance"], "confidence": [h[2] for h in hits], "weight": [h[3] for h in hits], "rank": ints["rank"]})

    def aligned(shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield rows_of(shared.value, pdf)

        return spread(src).mapInPandas(run, schema)

    head = entries.limit(most_broadcast + 1).toPandas()
    if len(head) <= most_broadcast:
        found = aligned(sc.broadcast(Aligner(head, Reader(groups))))
    else:
        listed, found = cut(entries), None
        shards = int(listed.count() * 5 // (most_broadcast * 4) + 1)
        for k in range(shards):
            part = listed.filter(F.pmod(F.xxhash64("key"), F.lit(shards)) == k).toPandas()
            shared = sc.broadcast(Aligner(part, Reader(groups)))
            won = cut(aligned(shared))
            found = won if found is None else found.unionAll(won)
            shared.destroy()
    best = Window.partitionBy("id").orderBy(F.col("distance").asc_nulls_last(), F.col("rank").asc_nulls_last(), F.col("weight").desc_nulls_last(), "entry")
    return found.withColumn("__n", F.row_number().over(best)).filter("__n = 1").select(F.col("id").alias(id_col), "entry", "distance", "confidence")
