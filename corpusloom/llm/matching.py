"""Matching of records of two sources that share no key: typed references and the works they cite.

Blocking is by multi-table hyperplane hashing of the vectors of single authors, of titles and of volume with page. Pairs of one bucket that
agree in nothing else are dropped by their 64-bit title signatures and numbers before they are shuffled. What is left
is compared exactly, by cosine and attribute by attribute, and a logistic curve over cosine and agreements, fitted on
references with an identifier, gives the confidence, which decides.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.embed import CONTEXTS, DIMS, Contexts, Kept, TokenVectors, around, grams, hyperplanes, segment_sums, signatures
from corpusloom.llm.lexicon import MOST_WORDS, with_lexicon
from corpusloom.llm.references import read_reference, read_work
from corpusloom.llm.text import banded, plain
from corpusloom.session import cut, spread

#: Pairs on which the confidence is fitted.
FIT_PAIRS = 20_000
#: Tasks that read the records for the token vectors, each of which sends one table of them to the driver (3 MB).
MOST_TABLES = 64
#: Hashed words whose document frequencies weight the titles' words.
WORD_BUCKETS = 1 << 17
NAME_TABLES, NAME_BITS, TITLE_TABLES, TITLE_BITS, PLACE_BITS = 1, 26, 3, 18, 30
#: Works of a bucket that one task takes; a bucket with more is split into parts of about so many.
HOT = 2000

_SCHEMA = "id bigint, side int, names string, title string, stems string, years array<int>, nums array<int>, spots string, doi string, tokens array<smallint>"


@contextmanager
def no_collection() -> Iterator[None]:
    """Puts off the search for cycles of garbage while the many small objects of a batch are made, none of which are in one."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def strings(col: pa.Array) -> list[str | None]:
    """The texts of a column; NumPy makes them faster than ``to_pylist``."""
    return col.to_numpy(zero_copy_only=False).tolist()


def read_records(works: DataFrame, refs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """Works (side 0) and references (side 1) with their attributes. A row delivered again stays: it agrees with the
    same works as the first one, and the choice of the best work for each reference leaves one of them. All given names
    that the register has three times or more are known to the reader of references."""
    given = works.select(F.explode("author").alias("a")).select(F.explode(F.split(F.lower("a.given"), "[\\s.-]+")).alias("g")).filter("length(g) > 2")
    tidy = F.pandas_udf(lambda s: s.map(plain), "string")
    given = given.groupBy("g").count().filter("count >= 3").select(tidy("g").alias("w")).distinct().withColumn("x", F.lit(1.0))

    types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]
    cols = ["id", "side", "names", "title", "stems", "years", "nums", "spots", "doi", "tokens"]

    def batch_of(ids: pa.Array, side: int, rows: list[tuple]) -> pa.RecordBatch:
        names, title, stems, years, nums, doi = zip(*rows) if rows else [()] * 6
        fields = ([" ".join(n) for n in names], title, stems, years, nums, [" ".join(places(side, y, n)) for y, n in zip(years, nums)], doi)
        return pa.RecordBatch.from_arrays([ids, pa.array([side] * len(rows), pa.int32()), *[pa.array(f, t) for f, t in zip(fields, types)], contexts(names, title, stems, years)], names=cols)

    def read_works(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, families, *fields = b.columns
            flat, ends = strings(families.flatten()), np.cumsum(families.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            with no_collection():
                out = batch_of(ids, 0, [read_work(flat[k:e], *x) for k, e, x in zip([0, *ends], ends, zip(*map(strings, fields)))])
            yield out

    def read_refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, author = strings(b.column(1)), strings(b.column(2))
            given = [dict(x or ()) for x in b.column(3).to_pylist()] if known is None else [known.value] * len(raw)
            with no_collection():
                out = batch_of(b.column(0), 1, [read_reference(*x) for x in zip(raw, author, given)])
            yield out

    w = works.select(
        F.col("work_id").cast("bigint").alias("id"), F.col("author.family").alias("families"), "title", F.col("issued").cast("string").alias("issued"), F.coalesce("source_long", "source_short").alias("source"),
        F.col("volume").cast("string").alias("volume"), F.col("first_page").cast("string").alias("page"), "doi",
    )
    r = refs.select(F.col("ref_id").cast("bigint").alias("id"), F.col("raw_ref").cast("string").alias("raw"), F.col("author").cast("string").alias("author"))
    r, known = with_lexicon(r, "id", ["raw", "author"], lambda row: plain(" ".join(x for x in row if x).replace("'", "").replace("’", "")).split(), given, most_words)
    return cut(spread(w).mapInArrow(read_works, _SCHEMA).unionAll(spread(r).mapInArrow(read_refs, _SCHEMA)))


def word_weights(records: DataFrame) -> np.ndarray:
    """Inverse document frequencies of hashed title words over all records."""
    words = records.select(F.explode(F.array_distinct(F.split("title", " "))).alias("w")).filter("w != ''")
    rows = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(WORD_BUCKETS)).cast("int").alias("b")).count().toPandas()
    df = np.zeros(WORD_BUCKETS)
    df[rows["b"].to_numpy(int)] = rows["count"].to_numpy(float)
    return np.log1p(max(1.0, df.max()) / np.maximum(1, df)).astype(np.float32)


class Model:
    """What workers need to make vectors: trained tokens, title word weights, hyperplanes."""

    def __init__(self, trained: Contexts, weights: np.ndarray):
        self.trained, self.weights = trained, weights
        self._made = False

    def __getstate__(self):
        return self.trained, self.weights

    def __setstate__(self, state):
        self.trained, self.weights = state
        self._made = False

    def make(self) -> Model:
        if not self._made:
            self.vectors = TokenVectors(self.trained)
            name_planes = hyperplanes(NAME_TABLES, NAME_BITS, seed=31)
            self.title_planes = hyperplanes(TITLE_TABLES, TITLE_BITS, seed=37)
            self.place_sides = self.vectors.table @ hyperplanes(1, PLACE_BITS, seed=43)
            self.check_planes = hyperplanes(1, 62, seed=41)
            self.weight = Weights(self.weights).__getitem__
            self.words = Kept(lambda ws: self.vectors.of(ws) * np.array([self.weight(w) for w in ws], np.float32)[:, None])
            self.names = Kept(lambda ns: signatures(self.vectors.of(ns), name_planes, NAME_TABLES, NAME_BITS))
            self._made = True
        return self

    def titles(self, titles: list[str]) -> np.ndarray:
        out = self.words.sums([t.split() for t in titles])
        return np.zeros((len(titles), self.vectors.dims), np.float32) if out is None else out

    def places(self, spots: list[str]) -> np.ndarray:
        """The side of each hyperplane on which a volume with its page lies. No such token is trained, so the sums of its
        letter n-grams may be taken on the hyperplanes at once."""
        return (segment_sums(self.place_sides, *grams(spots)) > 0) @ (np.int64(1) << np.arange(PLACE_BITS, dtype=np.int64))


class Buckets(dict):
    """The bucket of each word behind a mark, as Spark's xxhash64 gives it; begun anew when 300,000 words are held."""

    def __init__(self, mark: str = ""):
        super().__init__()
        self.mark = mark

    def __missing__(self, word: str | int) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = b = xxhash.xxh64_intdigest(f"{self.mark}{word}".encode(), 42) % WORD_BUCKETS
        return b


_buckets_of, _stems_of, _years_of = Buckets(), Buckets("s:"), Buckets("y:")


class Weights(dict):
    """The weight of each word; begun anew when 300,000 words are held."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        self[word] = x = float(self.weights[_buckets_of[word]])
        return x


def _context(token: str) -> int:
    return _buckets_of[token] % CONTEXTS


def contexts(names: list[list[str]], titles: list[str], stems: list[str], years: list[list[int]]) -> pa.Array:
    """The hashed tokens of each record, as ``_context`` gives them."""
    word, stem, year = _buckets_of.__getitem__, _stems_of.__getitem__, _years_of.__getitem__
    ids = [[*map(word, n), *map(word, t.split()), *map(stem, s.split()), *map(year, y)] for n, t, s, y in zip(names, titles, stems, years)]
    flat = np.fromiter(chain.from_iterable(ids), np.int32) % CONTEXTS
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32)), pa.array(flat.astype(np.int16)))


def _contexts():
    """Column: the same, of records that were not read here; CONTEXTS is a power of two."""
    marked = lambda mark, x: F.concat(F.lit(mark), F.replace(x, F.lit(" "), F.lit(" " + mark)))
    some = lambda x: F.when(x != "", x)
    years = F.array_join(F.col("years").cast("array<string>"), " ")
    text = F.concat_ws(" ", some(F.col("names")), some(F.col("title")), marked("s:", some(F.col("stems"))), marked("y:", some(years)))
    return F.transform(F.split(some(text), " "), lambda x: F.xxhash64(x).bitwiseAND(F.lit(CONTEXTS - 1)).cast("smallint")).alias("tokens")


def walk_vectors(records: DataFrame, rounds: int = 2) -> np.ndarray:
    """Vectors of hashed tokens by what walks over all records meet around them, one record away and, in the second round,
    two."""
    table = np.random.default_rng(53).standard_normal((CONTEXTS, DIMS)).astype(np.float32) / DIMS**0.5
    rows = (records.select("tokens") if "tokens" in records.columns else cut(records.select(_contexts()))).filter("tokens is not null").coalesce(MOST_TABLES)
    out = np.zeros_like(table)
    for _ in range(rounds):
        shared = records.sparkSession.sparkContext.broadcast(table)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros((CONTEXTS, DIMS), np.float64), np.zeros(CONTEXTS, np.int64)
            for b in batches:
                more, seen = around(b.column(0).flatten().to_numpy(), np.diff(b.column(0).offsets.to_numpy()), shared.value)
                sums += more
                n += seen
            yield pa.RecordBatch.from_arrays([pa.array([sums.astype(np.float32).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["sums", "n"])

        sums, n = np.zeros((CONTEXTS, DIMS)), np.zeros(CONTEXTS, np.int64)
        for r in rows.mapInArrow(add, "sums binary, n binary").collect():
            sums += np.frombuffer(r["sums"], np.float32).reshape(CONTEXTS, DIMS)
            n += np.frombuffer(r["n"], np.int64)
        table = Contexts.centred(sums, n)
        out += table
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float16)


def fit_model(records: DataFrame) -> Model:
    """The token vectors and the weights of title words, over all records."""
    return Model(Contexts(walk_vectors(records), _context), word_weights(records))


def places(side: int, years: list[int], nums: list[int]) -> list[str]:
    """Volume and page as one token; of a reference all pairs of its numbers, in their order, that may be these."""
    if side == 0:
        return [f"{nums[0]}:{nums[1]}"] if min(nums) >= 0 else []
    rest = [n for n in nums if n not in years[:1]]
    # the volume comes first, behind the number of a part at most; an issue may stand between it and the page
    if len(rest) == 4:
        return [f"{rest[0]}:{rest[2]}", f"{rest[1]}:{rest[2]}", f"{rest[0]}:{rest[1]}"]
    return [f"{a}:{b}" for a, b in zip(rest, rest[1:])] + ([f"{a}:{b}" for a, b in zip(rest, rest[2:])] if len(rest) > 4 else [])


def lists_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and how many each list has."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(col.offsets.to_numpy())


def number_marks(numbers: np.ndarray, size: np.ndarray, bits: int = 63) -> np.ndarray:
    """For each list of numbers a bit for each number, modulo ``bits``; those below 0 have none."""
    out = np.zeros(len(size), np.int64)
    some = np.flatnonzero(size)
    if len(some):
        marks = np.where(numbers >= 0, np.int64(1) << (numbers % bits), np.int64(0))
        out[some] = np.bitwise_or.reduceat(marks, (np.cumsum(size) - size)[some])
    return out


def _buckets(records: DataFrame, model) -> DataFrame:
    """(key, id, sig, nums, more, years): a row for each table and vector of a record. sig is its title's signature; nums
    and years have a bit for each number, of 63, and more one of 61, so that a shared number always shows in both and
    others seldom do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for b in batches:
            if not b.num_rows:
                continue
            ids, names, titles = b.column(0), *(b.column(k).to_numpy(zero_copy_only=False).tolist() for k in (1, 2))
            vectors = m.titles(titles)
            check = signatures(vectors, m.check_planes, 1, 62)[:, 0]
            check[[not t for t in titles]] = -1
            keys = signatures(vectors, m.title_planes, TITLE_TABLES, TITLE_BITS) + (np.arange(1, TITLE_TABLES + 1, dtype=np.int64) << 32)
            # titles of one or two words say nothing by themselves
            long = np.flatnonzero([t.count(" ") >= 2 for t in titles])
            rec, key = [np.repeat(long, TITLE_TABLES)], [keys[long].ravel()]
            single = [[n for n in x.split() if len(n) > 2] for x in names]
            at = m.names.index([n for x in single for n in x])
            if len(at):
                rec.append(np.repeat(np.arange(len(single)), [NAME_TABLES * len(x) for x in single]))
                key.append((m.names.rows[at] + (np.arange(33, 33 + NAME_TABLES, dtype=np.int64) << 32)).ravel())
            spots = [x.split() for x in b.column(5).to_numpy(zero_copy_only=False).tolist()]
            if any(spots):
                rec.append(np.repeat(np.arange(len(spots)), [len(x) for x in spots]))
                key.append(m.places([x for y in spots for x in y]) + (np.int64(65) << 32))
            rec, key = np.concatenate(rec), np.concatenate(key)
            order = np.lexsort((key, rec))
            rec, key = rec[order], key[order]
            new = np.ones(len(rec), bool)
            new[1:] = (rec[1:] != rec[:-1]) | (key[1:] != key[:-1])
            rec, key = rec[new], key[new]
            (years, n_years), (nums, n_nums) = (lists_of(b.column(k)) for k in (3, 4))
            marks = [number_marks(nums, n_nums), number_marks(nums, n_nums, 61), number_marks(years, n_years)]
            yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(rec)), pa.array(check[rec]), *[pa.array(x[rec]) for x in marks]], names=["key", "id", "sig", "nums", "more", "years"])

    return records.select("id", "names", "title", "years", "nums", "spots").mapInArrow(run, "key bigint, id bigint, sig bigint, nums bigint, more bigint, years bigint")


def candidates(records: DataFrame, model: Model, hot: int = HOT) -> DataFrame:
    """(work_id, ref_id): pairs of one bucket that agree in title signature or in numbers.

    The works of a bucket that holds more than ``hot`` are spread over as many tasks as that takes, each of which sees all
    its references, so no pair is lost; what the filter drops is never shuffled.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)
    works = cut(_buckets(records.filter("side = 0"), shared).select("key", F.col("id").alias("work_id"), F.col("sig").alias("ws"), F.col("nums").alias("wn"), F.col("more").alias("wm"), F.col("years").alias("wy")))
    w = works.withColumn("name", F.col("key") >= (33 << 32))
    r = _buckets(records.filter("side = 1"), shared).select("key", F.col("id").alias("ref_id"), F.col("sig").alias("rs"), F.col("nums").alias("rn"), F.col("more").alias("rm"), F.col("years").alias("ry"))
    apart = F.bit_count(F.col("ws").bitwiseXOR(F.col("rs")))
    both = (F.col("ws") >= 0) & (F.col("rs") >= 0)
    shared_numbers = F.bit_count(F.col("wn").bitwiseAND(F.col("rn")))
    some = (shared_numbers >= 1) & (F.col("wm").bitwiseAND(F.col("rm")) != 0)
    all_ = some & (shared_numbers == F.bit_count("wn"))
    year = F.col("wy").bitwiseAND(F.col("ry")) != 0
    turned = F.col("wy").bitwiseOR(F.shiftleft(F.col("wy"), 1)).bitwiseOR(F.shiftright(F.col("wy"), 1)).bitwiseOR(F.shiftright(F.col("wy"), 62)).bitwiseOR(F.shiftleft(F.col("wy"), 62))
    near = (F.col("wy") == 0) | (F.col("ry") == 0) | (turned.bitwiseAND(F.col("ry")) != 0)
    title, spot = ~F.col("name") & (F.col("key") < (33 << 32)), F.col("key") >= (65 << 32)
    alike = both & (apart <= 16)
    agree = (
        (spot & some & (near | (both & (apart <= 20))))
        | (~title & ~spot & (all_ | (some & (~both | (apart <= 24)))))
        | (title & ((all_ & (year | alike)) | (some & year & alike)))
        | (both & (apart <= F.when(F.col("name"), F.when(near, 22).otherwise(14)).when(near, 6).otherwise(3)))
    )
    crowded = cut(w.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    if crowded.limit(1).count() == 0:
        return w.join(r, "key").filter(agree).select("work_id", "ref_id").distinct()
    cold = w.join(crowded, "key", "left_anti").join(r, "key").filter(agree).select("work_id", "ref_id")
    hw = w.join(crowded, "key").withColumn("salt", F.expr("cast(pmod(xxhash64(work_id), parts) as int)")).drop("parts")
    hr = r.join(crowded, "key").withColumn("salt", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    return cold.unionAll(hw.join(hr, ["key", "salt"]).filter(agree).select("work_id", "ref_id")).distinct()


#: What is kept of a comparison; the rest is in the score.
FEATURES = ("cosine", "words", "head", "doi")


def same_word(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) < 4 or len(b) < 4 or abs(len(a) - len(b)) > 2 or (a[:2] != b[:2] and a[-2:] != b[-2:] and a[2:5] != b[2:5]):
        return False
    most = 1 if min(len(a), len(b)) < 7 else 2
    return banded(a, b, most) <= most


def _stretch(x: float) -> float:
    """Two titles of other works share a third of their trigrams; a title with some faults three quarters."""
    return min(1.0, max(0.0, (x - 0.35) / 0.5))


def letters(title: str) -> set[str]:
    """Letter trigrams of a title without its spaces, so that words torn apart do no harm."""
    t = title.replace(" ", "")
    return {t[i : i + 3] for i in range(len(t) - 2)}


#: How a further part of a work is marked in its title.
_later_part = regex.compile(r" (?:part (?:2|ii|two)|ii|second part)\b")


class Title:
    """What is compared of a title, made once for each title of a batch."""

    __slots__ = ("title", "words", "_grams", "total", "part")

    def __init__(self, title: str, weight):
        words: dict[str, float] = {}
        for w in title.split():
            words[w] = words.get(w, 0.0) + weight(w)
        self.title, self.words, self._grams, self.total = title, words, None, sum(words.values()) or 1e-9
        self.part = (" part" in title or " ii" in title) and _later_part.search(title) is not None

    @property
    def grams(self) -> set[str]:
        if self._grams is None:
            self._grams = letters(self.title)
        return self._grams


class Titles(dict):
    """Titles of a batch, made when they are first compared."""

    def __init__(self, weight):
        super().__init__()
        self.weight = weight

    def __missing__(self, title: str) -> Title:
        self[title] = made = Title(title, self.weight)
        return made


#: Small words of journals' names, by the stems that the readers make.
_small_stems = frozenset(("and", "und", "des", "fur"))


class Record:
    """What is compared of a record but its numbers: surnames, title, stems of the journal, identifier."""

    __slots__ = ("names", "title", "stems", "doi", "known")

    def __init__(self, packed: str):
        names, self.title, stems, self.doi = packed.split("\x1f")
        self.names = names.split()
        self.known = frozenset(self.names)
        self.stems = [x for x in stems.split() if x not in _small_stems]


class Records(dict):
    """Records of a batch by their packed form."""

    def __missing__(self, packed: str) -> Record:
        self[packed] = made = Record(packed)
        return made


def compare(ref: Record, work: Record, titles: dict[str, Title]) -> tuple[float, ...]:
    """(words, names, lead, stems, doi, head, part): agreements of a reference with a work; -1 where one has nothing to compare."""
    words = head = names = lead = stems = doi = -1.0
    part = 0.0
    if ref.title and work.title:
        if ref.title == work.title:
            words = head = 1.0
        else:
            x, y = titles[ref.title], titles[work.title]
            both = sum([min(g, y.words[w]) for w, g in x.words.items() if w in y.words])
            words, head = both / x.total, both / y.total
            if (words < 0.97 or head < 0.97) and x.grams and y.grams:
                both = len(x.grams & y.grams)
                words, head = max(words, _stretch(both / len(x.grams))), max(head, _stretch(both / len(y.grams)))
            part = float(x.part) - float(y.part)
    if ref.names and work.names:
        known, first = work.known, work.names[0]
        hits = [n for n in ref.names if n in known or any([same_word(n, m) for m in work.names])]
        names = min(1.0, len(hits) / min(len(ref.names), len(work.names)))
        lead = float(first in hits or any([same_word(n, first) for n in hits]))
    if ref.stems and work.stems:
        stems = sum([x in work.stems for x in ref.stems]) / max(len(ref.stems), len(work.stems))
    if ref.doi and work.doi:
        doi = 1.0 if ref.doi == work.doi else 0.6 if len(ref.doi) > 14 and (work.doi.startswith(ref.doi) or banded(ref.doi, work.doi, 2) <= 2) else 0.0
    return words, names, lead, stems, doi, head, part


def compare_numbers(years: tuple, nums: tuple, year: np.ndarray, volume: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, ...]:
    """(year, volume, page): agreements of the references' lists of years and numbers with each one's work, -1 where the
    work has none or the reference has too few to tell."""
    (y, ny), (n, nn) = years, nums
    has = lambda flat, size, want: np.bincount(np.repeat(np.arange(len(size)), size), flat == np.repeat(want, size), len(size)) > 0
    same, near = has(y, ny, year), has(y, ny, year - 1) | has(y, ny, year + 1)
    # a reference with a year only has neither volume nor page; one more number is one of them
    few = nn - np.minimum(1, ny)
    number = lambda want: np.where((want < 0) | (few < 1), -1.0, np.where(has(n, nn, want), 1.0, np.where(few > 1, 0.0, -1.0)))
    return np.where((ny == 0) | (year < 0), -1.0, np.where(same, 1.0, np.where(near, 0.5, 0.0))), number(volume), number(page)


def agreement(f: dict[str, np.ndarray]) -> np.ndarray:
    """A score of the agreements. Vectorised over pairs."""
    has = lambda c: f[c] >= 0
    score = np.full(len(f["words"]), -5.0)
    # a title that agrees as far as it goes
    score += np.where(has("words"), 9.0 * (f["words"] - 0.5) + 3.0 * (f["head"] - 0.5), 0.0)
    score += np.where(has("names"), np.where(f["names"] > 0, 1.0 + 1.5 * f["names"], -2.5), 0.0)
    score += np.where(has("lead") & (f["names"] > 0), np.where(f["lead"] > 0, 0.5, -0.5), 0.0)
    score += np.where(has("page"), np.where(f["page"] > 0, 3.0, -1.2), 0.0)
    score += np.where(has("volume"), np.where(f["volume"] > 0, 1.5, -0.8), 0.0)
    score += np.where(has("year"), np.where(f["year"] >= 1, 1.0, np.where(f["year"] > 0, 0.0, -1.0)), 0.0)
    score += np.where(has("stems"), 1.6 * (f["stems"] - 0.4), 0.0)
    # a title that is part of the other: a cut one, or that of another part of the work, which figures and marks tell
    less = has("words") & ((f["head"] < 0.65) | (f["words"] < 0.75) & (f["head"] > 0.85))
    off = (f["page"] == 0) & (f["volume"] <= 0) | (f["page"] < 0) & (f["year"] == 0)
    score -= np.where(less & off, 4.0, 0.0)
    score -= np.where((f["part"] != 0) & (f["page"] <= 0) & ~(less & off), 5.0, 0.0)
    return score + np.where(f["doi"] >= 1, 4.0, np.where(f["doi"] > 0, 2.0, 0.0))


def score_pairs(records: DataFrame, pairs: DataFrame, model: Model) -> DataFrame:
    """(work_id, ref_id, the features, score): the exact comparison of each candidate."""
    shared = records.sparkSession.sparkContext.broadcast(model)
    packed = F.concat_ws("\x1f", "names", "title", "stems", "doi")
    number = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(-1))
    works = records.filter("side = 0").select(F.col("id").alias("work_id"), packed.alias("work"), number("years", 0).alias("year"), number("nums", 0).alias("volume"), number("nums", 1).alias("page"))
    refs = records.filter("side = 1").select(F.col("id").alias("ref_id"), packed.alias("ref"), "years", "nums")
    rows = pairs.join(works, "work_id").join(refs, "ref_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(shared)
        for b in batches:
            if not b.num_rows:
                continue
            with no_collection():
                made = Records()
                refs, works = ([made[x] for x in b.column(k).to_numpy(zero_copy_only=False).tolist()] for k in (2, 3))
                titles = {t: k for k, t in enumerate(dict.fromkeys([r.title for x in (refs, works) for r in x]))}
                v, by_title = m.titles(list(titles)), Titles(m.weight)
                f = dict(zip(("words", "names", "lead", "stems", "doi", "head", "part"), np.array([compare(r, w, by_title) for r, w in zip(refs, works)]).T))
            f["cosine"] = (v[[titles[r.title] for r in refs]] * v[[titles[w.title] for w in works]]).sum(1)
            f["year"], f["volume"], f["page"] = compare_numbers(lists_of(b.column(4)), lists_of(b.column(5)), *(b.column(k).to_numpy() for k in (6, 7, 8)))
            score = agreement(f)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(f[c].astype(np.float32)) for c in FEATURES], pa.array(score)], names=["work_id", "ref_id", *FEATURES, "score"])

    kinds = ", ".join(f"{c} float" for c in FEATURES)
    return rows.select("work_id", "ref_id", "ref", "work", "years", "nums", "year", "volume", "page").mapInArrow(run, f"work_id bigint, ref_id bigint, {kinds}, score double")


def model_of(shared) -> Model:
    return shared.value.make()


#: Weights before anything is learnt: of the cosine above 0.7, of the agreement of the titles, of the other agreements, and
#: the constant; and how many pairs they are worth against the labelled ones.
PRIOR, WORTH = (2.0, 1.0, 1.0, 0.0), 5.0


def calibrate(scored: DataFrame, most: int = FIT_PAIRS) -> np.ndarray:
    """Weights of a logistic curve over cosine, titles and other agreements, fitted on at most ``most`` pairs whose reference
    has an identifier that either is the work's or is nothing like it. They start from PRIOR, which few pairs hardly change."""
    x, y = _evidence(), F.col("doi") > 0.5
    rows = scored.filter("doi = 1 or doi = 0").orderBy(F.xxhash64("ref_id", "work_id")).limit(most).select(*x, y.cast("double").alias("y")).toPandas().to_numpy(float)
    x, y = np.c_[rows[:, :3], np.ones(len(rows))], rows[:, 3]
    prior = np.array(PRIOR)
    v = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ v))
        v -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + WORTH * np.eye(4), x.T @ (p - y) + WORTH * (v - prior))
        v[:3] = np.maximum(v[:3], 0)  # no agreement speaks against a match
    return v


def _evidence() -> list:
    """Columns: the cosine above 0.7 where both have a title, the titles' agreement, the other agreements but the identifier."""
    titled = F.col("words") >= 0
    title = F.when(titled, 9.0 * (F.col("words") - 0.5) + 3.0 * (F.col("head") - 0.5)).otherwise(0.0)
    return [F.when(titled, F.col("cosine") - 0.7).otherwise(0.0).alias("x0"), title.alias("x1"), (F.col("score") - title - _identified()).alias("x2")]


def _identified():
    return F.when(F.col("doi") >= 1, 4.0).when(F.col("doi") > 0, 2.0).otherwise(0.0)


def match_references(works: DataFrame, refs: DataFrame, least: float = 0.5) -> DataFrame:
    """(work_id, ref_id, cosine, score, confidence): the work that each reference cites, if it is one of the register.

    A reference cites the work in which the calibrated confidence is highest, if it is at least ``least``. Redelivered
    rows count once. References without text, and those that name nothing, match nothing; of works that agree alike the
    one with the higher cosine, then the lower id is taken. Empty tables give an empty result.
    """
    records = read_records(works, refs)
    model = fit_model(records)
    scored = cut(score_pairs(records, candidates(records, model), model))
    w = [float(x) for x in calibrate(scored)]
    z = sum(F.lit(k) * c for k, c in zip(w, _evidence())) + F.lit(w[2]) * _identified() + F.lit(w[3])
    rows = scored.withColumn("confidence", 1 / (1 + F.exp(-z))).filter(F.col("confidence") >= least)
    best = Window.partitionBy("ref_id").orderBy(F.col("confidence").desc(), F.col("cosine").desc(), "work_id")
    return rows.withColumn("n", F.row_number().over(best)).filter("n = 1").select("work_id", "ref_id", "cosine", "score", "confidence")
