"""Variant spellings of people's names, and the profiles of one person.

Surnames that differ by a few typing faults are found by what is left of them without the letters that the faults can
touch; long ones, of which that would be too much, by a pigeonhole segment join: a name cut into k + 1 segments
keeps one of them unharmed under k faults, so its segments are indexed and every other name looks up the substrings
that could be that segment, given how far faults can have shifted it; a banded edit distance decides. Profiles of one
surname family whose given names agree are linked if their e-mail, affiliation, co-authors or subjects agree too;
those of two spellings that no frequency puts into one family, if their e-mail, affiliation or co-authors agree; for
these, one fault in a name of three or four letters and one exchange of neighbours count too.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.graph import components
from corpusloom.llm.lexicon import MOST_WORDS, with_lexicon
from corpusloom.llm.text import banded, fold, plain, with_swaps
from corpusloom.session import cut, once

#: Particles of surnames, short forms of given names, words of organisations' names, prepositions in titles.
PARTICLES = frozenset(("de", "du", "des", "d", "la", "le", "van", "von", "vom", "der", "den", "ter", "della", "di", "del", "da", "dos", "zu"))
SHORT_GIVEN = {
    "alex": ("alexander", "alexandra"), "barb": ("barbara",), "bea": ("beatriz",), "becky": ("rebecca",), "ben": ("benjamin",), "beth": ("elisabeth",),
    "bill": ("william",), "bob": ("robert",), "cathy": ("catherine",), "charlie": ("charles",), "chris": ("christopher", "christine"), "dan": ("daniel",),
    "debbie": ("deborah",), "dick": ("richard",), "rick": ("richard",), "dom": ("dominique",), "ed": ("edward",), "ted": ("theodore", "edward"), "flo": ("florence",),
    "franca": ("francesca",), "fred": ("frederick",), "gabi": ("gabriela",), "hans": ("johannes",), "isa": ("isabelle",), "jackie": ("jacqueline",), "joe": ("joseph",),
    "jon": ("jonathan",), "kate": ("katherine",), "laure": ("laurence",), "leo": ("leonardo",), "lisa": ("elisabeth",), "liz": ("elisabeth",), "maggie": ("margaret",),
    "manu": ("emmanuel",), "matt": ("matthias",), "max": ("maximilian",), "mike": ("michael",), "nat": ("natalia",), "nico": ("nicolas",), "paco": ("francisco",),
    "pat": ("patricia",), "peggy": ("margaret",), "sandra": ("alexandra",), "phil": ("philippe",), "rafa": ("raphael",), "sam": ("samuel",), "seb": ("sebastien",), "steph": ("stephane",), "sue": ("susanna",),
    "tim": ("timothy",), "tom": ("thomas",), "tony": ("anthony",), "vicky": ("victoria",), "vince": ("vincent",), "will": ("william",), "wolf": ("wolfgang",),
}
NO_NAME = frozenset(
    "university universite universidad universita universitat institute institut instituto istituto centre center centro zentrum laboratory laboratoire "
    "laboratorio school ecole escuela scuola hochschule akademie department departement foundation biology biologie biologia biologia physics physique "
    "fisica physik chemistry chimie chimica quimica chemie geology geologie geologia ecology ecologie ecologia okologie medicine medecine medicina medizin "
    "linguistics linguistique linguistica neuroscience neurosciences neurosciencias neuroscienze neurowissenschaften materials materiaux materiales materiali "
    "werkstoffe sprachen saint sainte sankt santa upper great haute neuve mount sierra villa upon foret bains mitte".split()
)
PREPOSITIONS = frozenset("in under through without after with against for near across beyond during the of and between from by to on at over".split())

#: What is read of a profile.
PROFILE = ["profile_id", "firstName", "lastName", "email", "affiliations", "titles", "coAuthors"]
_initials = regex.compile(r"(?:\p{L}\.?-)+\p{L}\.?")
_parts = regex.compile(r"[-.\s]+")
_word = regex.compile(r"[\p{L}'’]+(?:[-‐][\p{L}'’]+)*\.?")


def faults(n: int) -> int:
    """Typing faults allowed in a name of n letters."""
    return 0 if n < 5 else 1 if n < 8 else 2


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 even segments of a name of n letters."""
    size, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        length = size + (i > k - more)
        out.append((at, length))
        at += length
    return out


def index_keys(s: str) -> list[str]:
    n = len(s)
    return [f"{n}:{i}:{s[p : p + m]}" for i, (p, m) in enumerate(segments(n, faults(n)))]


def lookup_keys(r: str) -> list[str]:
    """Keys under which a name no longer than r, and not more faults away than it allows, has a segment."""
    size, out = len(r), set()
    for n in range(max(1, size - 2), size + 1):
        k, shift = faults(n), size - n
        if shift > k:
            continue
        for i, (p, m) in enumerate(segments(n, k)):
            lo = max(0, p - i, p + shift - (k - i))
            hi = min(size - m, p + i, p + shift + (k - i))
            out.update(f"{n}:{i}:{r[at : at + m]}" for at in range(lo, hi + 1))
    return sorted(out)


#: Letters of the shorter of two names from which on segments are compared, long enough there to be met by few other names.
LONG = 16
_mixed = np.random.default_rng(47).integers(1, 1 << 63, (3, LONG + 2), dtype=np.uint64) | np.uint64(1)


def dropped(n: int) -> list[tuple[int, int]]:
    """(faults, letters): how many letters a name of n letters goes without for a number of faults. Of two names of a length
    each goes without as many as there are faults; the shorter one without as many fewer as it is shorter."""
    out = []
    for k, least, most in ((1, 5, 7), (2, 8, LONG - 1)):
        if least <= n <= most + k:
            out += [(k, m) for m in (range(k + 1) if n <= most else (k,))]
    return out


def left_keys(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(which name, hash of what is left of it without some letters): two names of 5 letters or more, the shorter of which is
    under LONG, share one if they are within its faults."""
    size = np.fromiter(map(len, names), np.int64, len(names))
    which, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(size).tolist():
        if not (ways := dropped(n)):
            continue
        at = np.flatnonzero(size == n)
        codes = np.frombuffer("".join([names[k] for k in at]).encode("utf-32-le"), np.uint32).reshape(-1, n).T.astype(np.uint64)
        for k, m in ways:
            for left in combinations(range(n), n - m):
                keys.append((codes[list(left)] * _mixed[k, : n - m, None]).sum(0, dtype=np.uint64).view(np.int64))
                which.append(at)
    return np.concatenate(which), np.concatenate(keys)


def variant_pairs(names: DataFrame, col: str = "s") -> DataFrame:
    """(a, b, faults): pairs of distinct names within the faults that the shorter one allows, each pair once; exact."""

    def keys(of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text, key = [], []
                for s in b.column(0).to_pylist():
                    ks = of(s)
                    key += ks
                    text += [s] * len(ks)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(text, pa.string())], names=["key", "s"])

        return run

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 1000) for k in range(0, b.num_rows, 1000)):
                which, key = left_keys(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(which))], names=["key", "s"])

    src = names.select(F.col(col).alias("s")).filter("s is not null and s != ''").distinct()
    long = src.filter(F.length("s") >= LONG)
    index = long.mapInArrow(keys(index_keys), "key string, s string").withColumnRenamed("s", "a")
    looks = long.mapInArrow(keys(lookup_keys), "key string, s string").withColumnRenamed("s", "b")
    short = src.filter(F.length("s").between(5, LONG + 1)).mapInArrow(left, "key bigint, s string")
    pairs = looks.join(index, "key").select("a", "b").unionAll(short.withColumnRenamed("s", "a").join(short.withColumnRenamed("s", "b"), "key").select("a", "b"))
    near = F.length("a") < F.length("b")
    pairs = pairs.filter(near | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))))

    # the banded edit distance is Spark's own
    most = F.when(F.length("a") < 5, 0).when(F.length("a") < 8, 1).otherwise(2)
    near = pairs.withColumn("faults", F.levenshtein("a", "b", 2)).filter((F.col("faults") >= 0) & (F.col("faults") <= most))
    return near.distinct()


#: Lengths of the shorter of two names in which one fault or one exchange of neighbours is looked for.
ONE_FAULT = (3, 7)


def without_one(s: str) -> list[str]:
    """The name and all that is left of it without one letter: names that are one fault or exchange apart share one of these."""
    return [s, *dict.fromkeys(s[:k] + s[k + 1 :] for k in range(len(s)))]


def one_apart(a: str, b: str) -> bool:
    """Whether b, no shorter than a, is at most one fault or one exchange of neighbours away from a."""
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def close_pairs(names: DataFrame, col: str = "s") -> DataFrame:
    """(a, b), the shorter first: pairs of distinct names of which the shorter has ONE_FAULT letters and that are one
    fault or one exchange of neighbours apart; exact."""
    least, most = ONE_FAULT

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, s) for s in b.column(0).to_pylist() for k in without_one(s)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string())], names=["key", "s"])

    src = names.select(F.col(col).alias("s")).filter(F.length("s").between(least, most + 1)).distinct()
    keyed = src.mapInArrow(keys, "key string, s string")
    near = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    pairs = keyed.withColumnRenamed("s", "a").join(keyed.withColumnRenamed("s", "b"), "key").filter(near & (F.length("a") <= most)).select("a", "b").distinct()
    # an exchange of neighbours counts twice there
    pairs = pairs.filter(F.levenshtein("a", "b", 2) >= 0)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([one_apart(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

    return pairs.mapInArrow(verify, "a string, b string")


def families(names: DataFrame, col: str = "s", times: int = 3, pairs: DataFrame | None = None) -> DataFrame:
    """(s, fam) for every distinct name: the usual spelling that it is a variant of, or itself.

    A name is a variant of the nearest, then most frequent name within its faults that is at least ``times`` as frequent.
    Variants are never chained, so names that lie close to one another by chance do not grow into one family.
    ``pairs``: the names' variant_pairs where they are known already.
    """
    seen = cut(names.select(F.col(col).alias("s")).filter("s is not null and s != ''").groupBy("s").agg(F.count(F.lit(1)).alias("n")))
    pairs = variant_pairs(seen) if pairs is None else pairs
    both = pairs.unionAll(pairs.selectExpr("b as a", "a as b", "faults"))
    own, other = seen.select(F.col("s").alias("a"), F.col("n").alias("na")), seen.select(F.col("s").alias("b"), F.col("n").alias("nb"))
    usual = both.join(own, "a").join(other, "b").filter(F.col("nb") >= times * F.col("na"))
    chosen = usual.groupBy("a").agg(F.min_by("b", F.struct("faults", -F.col("nb"), "b")).alias("to"))
    return seen.join(chosen.withColumnRenamed("a", "s"), "s", "left").select("s", F.coalesce("to", "s").alias("fam"))


class NameReader:
    """Reads names into (given words, surname key). ``given``: folded word to the log odds of its being a given name."""

    def __init__(self, given: dict[str, float]):
        self.given = given

    def words(self, s: str) -> list[str]:
        return [w for w in _word.findall(s.replace("‐", "-")) if w.strip("'’.-")]

    @staticmethod
    @functools.lru_cache(100_000)
    def initial(w: str) -> bool:
        bare = w.rstrip(".")
        return len(bare) == 1 or (w.endswith(".") and len(bare) <= 2) or (len(bare) <= 3 and bare.isupper() and len(bare) > 1) or _initials.fullmatch(w) is not None

    def odds(self, w: str) -> float:
        f = fold(w).rstrip(".")
        return self.given.get(f, max((self.given.get(p, -1.0) for p in f.split("-")), default=-1.0) if "-" in f else -1.0)

    def key(self, words: list[str]) -> str:
        """Surname key: folded letters without particles."""
        parts = [p for w in words for p in plain(w.replace("'", " ").replace("’", " ")).split()]
        kept = [p for p in parts if p not in PARTICLES] or parts
        return "".join(kept)

    def split(self, s: str) -> tuple[list[str], str]:
        """A whole name in one string."""
        if "," in s:
            last, _, first = s.partition(",")
            return [fold(w).rstrip(".") for w in self.words(first)], self.key(self.words(last))
        words = self.words(s)
        if len(words) < 2:
            return [], self.key(words)
        upper = [w for w in words if w.isupper() and not self.initial(w)]
        if upper and len(upper) < len(words):
            # capitals mark the surname, and particles in front of it
            last = [w for w in words if w in upper or fold(w) in PARTICLES]
            return [fold(w).rstrip(".") for w in words if w not in last], self.key(last)
        first = [w for w in words if self.initial(w) or self.odds(w) > 0]
        last = [w for w in words if w not in first]
        if not last:
            # every word may be a given name: the least likely one is the surname
            low = min(words, key=lambda w: (self.initial(w), self.odds(w)))
            first, last = [w for w in words if w is not low], [low]
        if not first:
            first, last = words[:1], words[1:]
            if fold(words[0]) in PARTICLES:
                first, last = words[-1:], words[:-1]
        return [fold(w).rstrip(".") for w in first if fold(w) not in PARTICLES], self.key(last)

    def read(self, first: str | None, last: str | None) -> tuple[list[str], str]:
        first, last = (first or "").strip(), (last or "").strip()
        first, last = ("" if x.lower() in ("n/a", "-", "null", "none", "?") else x for x in (first, last))
        if not first or not last:
            return self.split(first or last) if first or last else ([], "")
        if "," in last or "," in first:
            return self.split(last if "," in last else first)
        a, b = self.words(first), self.words(last)
        if not a or not b:
            return self.split(f"{first} {last}")
        ini_a, ini_b = all(map(self.initial, a)), all(map(self.initial, b))
        swapped = (ini_b and not ini_a) or (not ini_a and not ini_b and max(map(self.odds, b)) > max(0.0, max(map(self.odds, a))))
        if swapped:
            a, b = b, a
        more = [w for w in b if self.odds(w) > 2 and len(b) > 1]
        if more and len(more) < len(b):  # the whole name in one field
            b = [w for w in b if w not in more]
        return [fold(w).rstrip(".") for w in a if fold(w) not in PARTICLES], self.key([*[w for w in a if fold(w) in PARTICLES], *b])


def _given_words(text: str | None) -> list[str]:
    return [fold(w).rstrip(".") for w in _word.findall(text or "") if len(w) > 2]


def given_names(profiles: DataFrame, first: str = "firstName", last: str = "lastName") -> DataFrame:
    """(w, x): words that stand in the field of given names, over all profiles, with the log odds of it; and short forms."""
    tidy = F.pandas_udf(lambda s: s.map(_given_words), "array<string>")
    side = lambda c, n: profiles.filter(F.col(c).isNotNull() & ~F.col(c).contains(",")).select(F.explode(tidy(c)).alias("w"), F.lit(n).alias("side"))
    rows = side(first, 1).unionAll(side(last, 0)).groupBy("w").agg(F.sum("side").alias("f"), F.sum(1 - F.col("side")).alias("l")).filter("f >= 3 and f > l")
    held = rows.select("w", F.log((F.col("f") + 0.5) / (F.col("l") + 0.5)).alias("x"), F.lit(1).alias("seen"))
    short = profiles.sparkSession.createDataFrame([(k, 1.0, 0) for k in SHORT_GIVEN], "w string, x double, seen int")
    return held.unionAll(short).groupBy("w").agg(F.max_by("x", "seen").alias("x"))


def _words_of(row: list) -> list[str]:
    """All words of a profile's names and co-authors, as the reader looks them up."""
    words = {fold(w).rstrip(".") for x in row if x is not None for t in ([x] if isinstance(x, str) else x) if t for w in _word.findall(t.replace("‐", "-"))}
    return [*words, *{p for w in words for p in w.split("-")}]


def same_given(a: list[str], b: list[str]) -> int:
    """How far two given names agree: 3 written out alike, 2 by a short form or a fault, 1 by initials or one missing, 0 not at all."""
    a, b = [x for w in a for x in _parts.split(w) if x], [x for w in b for x in _parts.split(w) if x]
    if not a or not b:
        return 1
    x, y = a[0], b[0]
    if len(x) <= 2 or len(y) <= 2:
        short, long = (a, b) if len(x) <= 2 else (b, a)
        letters = "".join(short)
        full = [long[0], *SHORT_GIVEN.get(long[0], ())]
        if not any(w[0] == letters[0] for w in full):
            return 0
        # both parts of a double name count if both are given
        return 0 if len(letters) > 1 and len(long) > 1 and len(long[1]) > 2 and letters[1] != long[1][0] else 1
    if x == y:
        second = [w for w in (a[1:2] + b[1:2])]
        if len(second) == 2 and second[0][0] != second[1][0]:
            return 0
        # "Marie" and "Marie-Helene" are two names, "Jean P." and "Jean" may be one
        if len(second) == 1 and len(second[0]) > 2:
            return 1
        return 3
    forms = lambda w: {w, *SHORT_GIVEN.get(w, ())}
    if forms(x) & forms(y):
        return 2
    if any(len(p) >= 5 and len(q) >= 5 and banded(p, q, 2) <= (1 if min(len(p), len(q)) < 7 else 2) for p in forms(x) for q in forms(y) if (p, q) != (x, y)):
        return 2
    short, long = sorted((x, y), key=len)
    if "".join(a) == "".join(b):
        return 3
    most = 1 if len(long) < 6 else 2
    if x[0] == y[0] and (banded(x, y, most) <= most or (len(short) >= 4 and with_swaps(x, y) <= 1)):
        return 2
    return 2 if banded(x, y, 1) <= 1 and len(long) >= 6 else 0


@functools.lru_cache(500_000)
def _level(a: str, b: str) -> int:
    return same_given(a.split(), b.split())


def given_level(a: str, b: str):
    """Column: how far the given names in two columns, their words joined by spaces, agree."""
    return F.pandas_udf(lambda x, y: pd.Series([_level(p, q) for p, q in zip(x, y)], dtype="int32"), "int")(a, b)


def topics(title: str | None) -> list[tuple[str, float]]:
    """The subject a title opens with: the words before its first preposition; two words say more than one."""
    words = plain(title).split() if title else []
    head = []
    for w in words:
        if w in PREPOSITIONS:
            break
        head.append(w)
    return [(" ".join(head), 2.0 if len(head) > 1 else 0.7)] if head else []


def read_profiles(df: DataFrame, given: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(profile_id, given, surname, coauthors, marks): the given names' words are joined by spaces; marks are pieces of
    evidence with their weights."""
    rows, shared = with_lexicon(df.select(*PROFILE), "profile_id", ["firstName", "lastName", "coAuthors"], _words_of, given, most_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = NameReader({} if shared is None else shared.value)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if shared is None:
                    reader.given = dict(r.known or ())
                first, surname = reader.read(r.firstName, r.lastName)
                marks: dict[str, float] = {}
                for e in r.email if r.email is not None else ():
                    if e and "@" in e:
                        marks["e:" + e.strip().lower()] = 5.0
                for a in r.affiliations if r.affiliations is not None else ():
                    words = plain(a).split()
                    if not words or "foundation" in words:
                        continue
                    names = [w for w in words if len(w) >= 5 and w not in NO_NAME]
                    for k, w in enumerate(names):
                        marks["a:" + w] = 4.0 if k == 0 else 1.5
                for t in r.titles if r.titles is not None else ():
                    for w, x in topics(t):
                        marks["t:" + w] = x
                others = {}
                for c in r.coAuthors if r.coAuthors is not None else ():
                    if c and c.strip():
                        g, s = reader.split(c)
                        if len(s) >= 3:
                            others[s] = g[0][0] if g else ""
                out.append((r.profile_id, " ".join(first), surname, sorted(others), [{"k": k, "w": w} for k, w in marks.items()]))
            yield pd.DataFrame(out, columns=["profile_id", "given", "surname", "coauthors", "marks"])

    id_type = df.schema["profile_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"profile_id {id_type}, given string, surname string, coauthors array<string>, marks array<struct<k:string,w:double>>")


def across_families(evidence: DataFrame, variants: DataFrame) -> DataFrame:
    """(a, b, ga, gb, k, w), a < b: each e-mail, affiliation or co-author that two profiles share whose surnames are
    variants of two families. A subject decides only within a family."""
    firm = evidence.filter("k not like 't:%'")
    a, b = (firm.select(F.col("surname").alias("s" + c), "k", *more, F.struct("profile_id", "given", "fam").alias(c)) for c, more in (("a", ["w"]), ("b", [])))
    both = variants.select(F.col("a").alias("sa"), F.col("b").alias("sb")).join(a, "sa").join(b, ["sb", "k"]).filter("a.fam != b.fam and a.profile_id != b.profile_id")
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "k", "w")
    return both.select(F.col("a.profile_id").alias("a"), F.col("b.profile_id").alias("b"), F.col("a.given").alias("ga"), F.col("b.given").alias("gb"), "k", "w")


def link_profiles(df: DataFrame, least: float = 2.0) -> DataFrame:
    """(profile_id, person, links): the person of each profile, named by its least profile_id, and its number of links.

    ``df``: profile_id, firstName, lastName, email, affiliations, titles, coAuthors. A profile delivered twice counts
    once; one without any name stands alone. Profiles of one surname family are compared only where they share a piece
    of evidence, so a frequent surname makes no group of all its profiles. Profiles of two families whose surnames are
    variants, whatever their frequencies, are compared where they share an e-mail, an affiliation or a co-author.
    Profiles with too little to compare go to the one person of their name, if there is one.
    """
    profiles = once(df.select(*PROFILE), "profile_id")
    rows = cut(read_profiles(profiles, given_names(profiles)))
    pool = rows.select(F.col("surname").alias("s")).unionAll(rows.select(F.explode("coauthors").alias("s")))
    variants = cut(variant_pairs(pool))
    known = cut(families(pool, pairs=variants))
    # faults in short names and exchanges count by shared evidence only: by chance many short names are that close
    spellings = cut(variants.select("a", "b").unionAll(close_pairs(rows, "surname")).distinct())
    family = lambda d, c, to: d.join(known.select(F.col("s").alias(c), F.col("fam").alias(to)), c)
    named = family(rows.filter("surname != ''").select("profile_id", "given", "surname"), "surname", "fam")
    marks = rows.select("profile_id", F.explode("marks").alias("m")).select("profile_id", F.col("m.k").alias("k"), F.col("m.w").alias("w"))
    others = family(rows.select("profile_id", F.explode("coauthors").alias("c")), "c", "cf").select("profile_id", F.concat(F.lit("c:"), "cf").alias("k"), F.lit(2.0).alias("w")).distinct()
    evidence = cut(named.join(marks.unionAll(others), "profile_id").filter(F.col("k") != F.concat(F.lit("c:"), "fam")).select("profile_id", "given", "surname", "fam", "k", "w"))
    kinds = evidence.groupBy("profile_id").agg(
        F.sum(F.col("k").startswith("a:").cast("int")).alias("na"), F.sum(F.col("k").startswith("c:").cast("int")).alias("nc"), F.sum(F.col("k").startswith("e:").cast("int")).alias("ne")
    )
    a = evidence.select("fam", "k", "w", F.col("profile_id").alias("a"), F.col("given").alias("ga"))
    b = evidence.select("fam", "k", F.col("profile_id").alias("b"), F.col("given").alias("gb"))
    within = a.join(b, ["fam", "k"]).filter("a < b").select("a", "b", "ga", "gb", "k", "w")
    shared = within.unionAll(across_families(evidence, spellings)).groupBy("a", "b").agg(
        F.first("ga").alias("ga"), F.first("gb").alias("gb"), F.sum("w").alias("score"),
        F.max(F.col("k").startswith("a:").cast("int")).alias("sa"), F.sum(F.col("k").startswith("c:").cast("int")).alias("sc"), F.max(F.col("k").startswith("e:").cast("int")).alias("se"),
    )
    ka, kb = (kinds.select(F.col("profile_id").alias(c), *[F.col(n).alias(n + c) for n in ("na", "nc", "ne")]) for c in ("a", "b"))
    pairs = shared.withColumn("level", given_level("ga", "gb")).filter("level > 0").join(ka, "a").join(kb, "b")
    # what both have and do not share speaks against
    against = (
        F.when((F.col("naa") > 0) & (F.col("nab") > 0) & (F.col("sa") == 0), 1.5).otherwise(0.0)
        + F.when((F.col("nca") >= 2) & (F.col("ncb") >= 2) & (F.col("sc") == 0), 1.5).otherwise(0.0)
        + F.when((F.col("nea") > 0) & (F.col("neb") > 0) & (F.col("se") == 0), 2.0).otherwise(0.0)
    )
    pairs = cut(pairs.withColumn("score", F.col("score") - against).filter(F.col("score") >= least).select("a", "b", "ga", "gb", "level", "score"))
    # names written out first; who gives initials only is added to the one group that fits best
    sure = pairs.filter("level >= 2")
    full = components(sure.select("a", "b"))
    spelt = F.exists(F.split("given", " "), lambda w: F.length(w) > 2)
    labels = named.withColumn("spelt", spelt).join(full.withColumnRenamed("node", "profile_id"), "profile_id", "left").withColumn("root", F.coalesce("root", "profile_id"))
    labels = cut(labels.select("profile_id", "fam", "given", "spelt", "root"))
    weak = pairs.filter("level = 1").select("a", "b", "score")
    weak = weak.unionAll(weak.selectExpr("b as a", "a as b", "score"))
    to = labels.select(F.col("profile_id").alias("b"), F.col("root").alias("rb"), F.col("spelt").alias("sb"))
    loose = labels.filter(~F.col("spelt")).select(F.col("profile_id").alias("a"))
    best = loose.join(weak, "a").join(to, "b").groupBy("a", "rb", "sb").agg(F.sum("score").alias("s"))
    order = Window.partitionBy("a").orderBy(F.col("sb").desc(), F.col("s").desc(), "rb")
    chosen = best.withColumn("n", F.row_number().over(order)).filter("n = 1").select("a", F.col("rb").alias("b"))
    double = pairs.filter("level = 1").join(labels.filter("spelt").select(F.col("profile_id").alias("a")), "a").join(labels.filter("spelt").select(F.col("profile_id").alias("b")), "b").select("a", "b")
    linked = components(sure.select("a", "b").unionAll(chosen).unionAll(double))
    persons = labels.drop("root").join(linked.withColumnRenamed("node", "profile_id"), "profile_id", "left").withColumn("root", F.coalesce("root", "profile_id"))
    persons = cut(persons)
    return attach_sparse(persons, kinds)


def attach_sparse(persons: DataFrame, kinds: DataFrame) -> DataFrame:
    """Profiles linked to none go to the one person of their family whose given name agrees, if there is one only and
    they have no kind of evidence (e-mail, affiliation, co-authors) in common that could have agreed and did not.

    Whether there is one only shows in three persons of a family's given name, so the names of a family are compared
    with no more than three persons each, however many bear them.
    """
    rows = persons.join(kinds, "profile_id", "left").fillna(0, ["na", "nc", "ne"])
    size = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias("m" + c) for c in ("na", "nc", "ne")])
    rows = cut(rows.join(size, "root").filter("given != ''"))
    bearers = rows.groupBy("fam", "given", "root").agg(*[F.first(c).alias(c) for c in ("mna", "mnc", "mne")])
    bearers = bearers.withColumn("nth", F.row_number().over(Window.partitionBy("fam", "given").orderBy("root"))).filter("nth <= 3")
    single = rows.filter("n = 1").select(F.col("profile_id").alias("a"), "fam", F.col("given").alias("ga"), F.col("spelt").alias("sa"), *[F.col(c).alias(c + "a") for c in ("na", "nc", "ne")])
    # who shares his name with two others of the family has more than one to go to
    crowded = bearers.filter("nth = 3").select("fam", F.col("given").alias("ga"))
    single = cut(single.join(crowded, ["fam", "ga"], "left_anti"))
    names = single.select("fam", "ga").distinct().join(bearers.select("fam", "given").distinct(), "fam").withColumn("level", given_level("ga", "given")).filter("level > 0")
    fits = single.join(names, ["fam", "ga"]).filter("level >= 2 or not sa").join(bearers, ["fam", "given"]).filter("a != root")
    apart = "(naa > 0 and mna > 0) or (nca > 1 and mnc > 1) or (nea > 0 and mne > 0)"
    alone = fits.groupBy("a").agg(F.min("root").alias("b"), F.max("root").alias("c"), F.max(F.expr(f"cast({apart} as int)")).alias("apart")).filter("b = c and apart = 0").select("a", "b")
    more = components(alone)
    out = persons.join(more.select(F.col("node").alias("root"), F.col("root").alias("r2")), "root", "left").select("profile_id", F.coalesce("r2", "root").alias("person"))
    return out.join(out.groupBy("person").agg((F.count(F.lit(1)) - 1).alias("links")), "person").select("profile_id", "person", "links")


def profile_pairs(persons: DataFrame) -> DataFrame:
    """(profile_id_a, profile_id_b), a < b: all pairs of profiles of one person."""
    a, b = persons.select("person", F.col("profile_id").alias("profile_id_a")), persons.select("person", F.col("profile_id").alias("profile_id_b"))
    return a.join(b, "person").filter("profile_id_a < profile_id_b").select("profile_id_a", "profile_id_b")
