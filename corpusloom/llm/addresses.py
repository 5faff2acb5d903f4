"""Postal addresses of one site in different writing.

An address is read into organisation, street, house number and town. Streets and organisations of one town become
weighted character n-gram vectors, candidates come from products of small blocks or an index of larger ones, and a pair holds if its house
number is the same and its cosine is high, or high enough for what an exact check of the spelling allows. A site is a street address with its organisation; a record without a street belongs
to the site of its organisation in its town.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.canonical import SHORT_WORDS, BKTree
from corpusloom.operators.graph import components
from corpusloom.llm.names import one_apart, segments
from corpusloom.llm.ngrams import similar_pairs
from corpusloom.llm.text import NearWords, banded, fold, plain, with_swaps
from corpusloom.session import cut, once

#: Kinds of organisations, departments and streets, and small words, in the languages of the addresses, folded.
ORG_WORDS = (
    "institute", "institut", "instituto", "istituto", "inst", "ist", "centre", "center", "centro", "zentrum", "ctr", "ctro", "ztr", "laboratory",
    "laboratoire", "laboratorio", "lab", "lba", "labor", "school", "ecole", "escuela", "scuola", "esc", "university", "universite", "universidad",
    "universita", "universitat", "universidade", "univ", "hochschule", "akademie", "academy", "academie", "college", "faculty", "faculte", "hopital", "hospital", "klinikum",
)
DEPT_WORDS = ("department", "dept", "departement", "dep", "departamento", "dpto", "dipartimento", "dip", "abteilung", "abt")
STREET_WORDS = (
    "street", "str", "st", "road", "rd", "avenue", "ave", "av", "lane", "ln", "la", "square", "sq", "drive", "dr", "rue", "r", "boulevard", "boul", "blvd", "bd",
    "route", "rte", "chemin", "chem", "ch", "place", "pl", "via", "v", "viale", "vle", "corso", "cso", "piazza", "pza", "calle", "c", "avenida", "avda",
    "plaza", "plz", "paseo", "pso", "quai", "impasse", "allee", "weg", "platz", "strasse",
)
GLUED_STREETS = ("strasse", "str", "weg", "allee", "platz", "pl", "gasse")
SMALL_WORDS = ("de", "d", "du", "des", "di", "dei", "del", "della", "la", "le", "les", "of", "fur", "for", "the", "and", "et", "y", "e")
NOT_KINDS = ("chemie", "chimie", "chimica", "quimica")  # near a street word, but none
NUMBER_WORDS = ("n", "no", "nr", "num", "nro", "n°")
BOX_WORDS = ("bp", "po", "box", "cp", "postfach", "apartado", "cs")

_author = regex.compile(r"^.{0,60}?\(\s*reprint author\s*\)|[^,;\n]*\(\s*reprint author\s*\)", regex.I)
#: Shortened street words that only their full stop tells from other words, and signs of which each needs one.
_pointed = [(regex.compile(p, regex.I), r, signs) for p, r, signs in (
    (r"\bla\.(?=\s|[,;]|$)", "lane ", "."), (r"\bc/\s*", "calle ", "/"), (r"\bcl\.\s*", "calle ", "."), (r"\bp\.?\s?º\s*", "paseo ", "º"), (r"\bp\.?zz?a\b\.?", "piazza ", "zZ"),
    (r"(?<=\p{L}{4})(?:al|w|pl|str)\.(?=\s|[,;]|\d|$)", "strasse ", "."), (r"\bv\.le\b", "viale ", "."), (r"\bc\.so\b", "corso ", "."),
)]
_separators = regex.compile(r"[,;\n\r()\[\]|]+|\s[-–—]\s|\s{2,}[-–—]\s*")
_dotted = regex.compile(r"\b(\p{L})\.(?=\p{L}{1,2}\b)")
_number_sign = regex.compile(r"\b[Nn](?:[°ºo]|o\.|r\.|º)\s*(?=\d)|#\s*(?=\d)|№\s*")
_coded, _numbered = regex.compile(r"[a-z]{1,3}-\d{5}"), regex.compile(r"\d{1,4}[a-z]?")
_tokens = regex.compile(r"\|\||\p{L}{1,3}-\d{5}\b|\d+[a-z]?\b|\p{L}+(?:['’]\p{L}+)?|\d+")


@dataclass(slots=True)
class Address:
    """The parts of an address; empty where missing."""

    org: str = ""
    field: str = ""
    acronym: str = ""
    street: str = ""
    number: str = ""
    town: str = ""
    postcode: str = ""
    country: str = ""
    rest: str = ""
    initials: str = ""


class AddressReader:
    """Reads addresses. ``towns``: folded names of towns; ``countries``: folded names and codes to a code."""

    def __init__(self, towns: set[str], countries: dict[str, str]):
        self.towns, self.countries = towns, countries
        self.longest = max((t.count(" ") + 1 for t in towns), default=1)
        self.first_words = {t.partition(" ")[0] for t in towns}
        self.by_word = {w: k for k, ws in (("org", ORG_WORDS), ("dept", DEPT_WORDS), ("street", STREET_WORDS), ("small", SMALL_WORDS)) for w in ws}
        self.by_word |= dict.fromkeys(NOT_KINDS, "")
        self.near_kinds = NearWords([(w, 1 if len(w) < 8 else 2) for w, k in self.by_word.items() if len(w) >= 5 and k != "small"])
        self.near_countries = NearWords([(c, 1 if len(c) < 7 else 2) for c in countries if len(c) >= 6])

    def kind(self, w: str) -> str:
        """What a word is: org, dept, street, small or empty; long words with a typing fault count too."""
        k = self.by_word.get(w)
        if k is None:
            at = self.near_kinds.find(w) if len(w) >= 5 else -1
            k = self.by_word[self.near_kinds.words[at][0]] if at >= 0 else ""
        return k

    def country(self, words: list[str]) -> str:
        name = " ".join(words)
        if name in self.countries:
            return self.countries[name]
        at = self.near_countries.find(name) if len(name) >= 6 else -1
        return self.countries[self.near_countries.words[at][0]] if at >= 0 else ""

    def read(self, value: str | None) -> Address:
        out = Address()
        if not value:
            return out
        text = _number_sign.sub(" ", _author.sub(" ; ", value) if "(" in value else value)
        for pattern, instead, signs in _pointed:
            if signs in text or (len(signs) > 1 and any(c in text for c in signs)):
                text = pattern.sub(instead, text)
        if "." in text:
            text = _dotted.sub(r"\1", text)
        raw = _tokens.findall(_separators.sub(" || ", text))
        tok, shown = [], []
        for w in raw:
            f = fold(w).replace("’", "'")
            if "'" in f:
                head, _, tail = f.partition("'")
                if len(head) <= 2:
                    tok += [head, tail]
                    shown += [head, w[len(head) + 1 :]]
                    continue
                f = f.replace("'", "")
            tok.append(f)
            shown.append(w)
        n = len(tok)
        use = [""] * n  # what each token has been taken for
        for i, w in enumerate(tok):
            if w == "||":
                use[i] = "sep"
        for i, w in enumerate(tok):  # numbers
            if _coded.fullmatch(w):
                use[i], out.postcode = "post", w[-5:]
            elif w.isdigit() and len(w) == 5:
                use[i], out.postcode = "post", w
            elif w == "cedex" or (len(w) == 5 and w != "cedex" and banded(w, "cedex", 1) <= 1):
                use[i] = "skip"
                if i + 1 < n and tok[i + 1].isdigit() and len(tok[i + 1]) <= 2:
                    use[i + 1] = "skip"
            elif w in BOX_WORDS and any(t.isdigit() for t in tok[i + 1 : i + 3]):
                for j in range(i, min(n, i + 3)):
                    use[j] = use[j] or "skip"
                    if tok[j].isdigit():
                        break
        for size in (3, 2, 1):  # countries
            for i in range(n - size + 1):
                if use[i] or (size > 1 and any(use[i + 1 : i + size])):
                    continue
                words = tok[i : i + size]
                if size == 1 and len(words[0]) <= 3 and not (shown[i].isupper() or (i in (0, n - 1) or use[i - 1] == "sep")):
                    continue
                if c := self.country(words):
                    # a short code within an organisation's or street's segment would be something else
                    free = len(words[0]) == 3 and shown[i].isupper() and not value.isupper()
                    if size == 1 and len(words[0]) <= 3 and not (free or i == 0 or use[i - 1] in ("sep", "post") or i == n - 1):
                        continue
                    out.country = out.country or c
                    for j in range(i, i + size):
                        use[j] = "country"
        free = [0] * (n + 1)  # how many free tokens follow one another from each on
        for i in range(n - 1, -1, -1):
            free[i] = 0 if use[i] else free[i + 1] + 1
        starts = [i for i in range(n - 1, -1, -1) if free[i] and tok[i] in self.first_words]
        for size in range(min(self.longest, n), 0, -1) if starts else ():  # town, the longest name first, the last of equals
            for i in starts:
                if not out.town and free[i] >= size and (t := " ".join(tok[i : i + size])) in self.towns and not (size == 1 and self.kind(t)):
                    out.town = t
                    use[i : i + size] = ["town"] * size
        if not out.town:  # a shortened first word
            for i in range(n - 1):
                for full in SHORT_WORDS.get(tok[i], ()):
                    for size in range(min(self.longest, n - i), 1, -1):
                        if not any(use[i : i + size]) and not out.town and (t := " ".join([full, *tok[i + 1 : i + size]])) in self.towns:
                            out.town = t
                            use[i : i + size] = ["town"] * size
        self._organisation(tok, use, out)
        self._street(tok, use, out)
        for i, w in enumerate(tok):
            if not use[i] and _numbered.fullmatch(w) and not out.number:
                out.number, use[i] = w, "number"
        for i, w in enumerate(tok):  # an acronym stands alone between separators
            alone = (i == 0 or use[i - 1] in ("sep", "number", "post", "country", "town")) and (i == n - 1 or use[i + 1] in ("sep", "number", "post", "country", "town", "street"))
            if not use[i] and not out.org and not out.acronym and 3 <= len(w) <= 5 and w.isalpha() and not self.kind(w) and (alone if len(w) == 3 else shown[i].isupper() and (alone or value.upper() != value)):
                out.acronym, use[i] = w, "acronym"
        left, part = [], []
        for i, w in enumerate([*tok, "||"]):
            if i == n or use[i]:
                if part:
                    left.append(" ".join(part))
                part = []
            elif not (w in NUMBER_WORDS or (len(w) == 1 and not part)):
                part.append(w)
        if not out.town and left:  # a town that the list lacks or that is misspelt
            near = [i for i in range(n) if use[i] == "post"]
            best = left[-1]
            if near:
                for k in (near[0] + 1, near[0] - 1):
                    if 0 <= k < n and not use[k]:
                        best = next((p for p in left if tok[k] in p.split()), best)
                        break
            out.town = best
            left.remove(best)
        if out.number and not out.street and left:  # a street whose kind is misspelt
            out.street = left.pop(0)
        out.rest = " ".join(left)
        return out

    def _take(self, tok: list[str], use: list[str], i: int, step: int, what: str, most: int) -> list[str]:
        """Up to ``most`` free words from position i on, small words skipped."""
        got = []
        while 0 <= i < len(tok) and len(got) < most and not use[i] and not tok[i][0].isdigit():
            k = self.kind(tok[i])
            if k and k != "small":
                break
            if k == "small":
                if step < 0:
                    break
                use[i] = what
            else:
                got.append(tok[i])
                use[i] = what
            i += step
        return got[::step]

    def _organisation(self, tok: list[str], use: list[str], out: Address) -> None:
        n = len(tok)
        for i in range(n):  # departments with their subject do not matter
            if not use[i] and self.kind(tok[i]) == "dept":
                use[i] = "skip"
                j = i + 1
                while j < n and not use[j] and self.kind(tok[j]) == "small":
                    use[j] = "skip"
                    j += 1
                if j < n and not use[j]:
                    use[j] = "skip"
        for i in range(n):
            if use[i] or self.kind(tok[i]) != "org":
                continue
            use[i] = "org"
            of = i + 1 < n and not use[i + 1] and tok[i + 1] in ("of", "fur", "o", "f", "fr")
            if of or (i + 1 >= n or use[i + 1]):
                name = self._take(tok, use, i - 1, -1, "org", 1)
                subject = self._take(tok, use, i + 2, 1, "org", 1) if of else []
                if of:
                    use[i + 1] = "org"
            else:
                name = self._take(tok, use, i + 1, 1, "org", 1)
                j = i + 1
                while j < n and use[j] == "org":
                    j += 1
                small = j < n and not use[j] and self.kind(tok[j]) == "small"
                subject = self._take(tok, use, j, 1, "org", 1) if small else []
            if name and not out.org:
                out.org, out.field = " ".join(name), " ".join(subject)
                out.acronym = ""
                first = (name[0][0] + tok[i][0]) if of else (tok[i][0] + name[0][0])
                out.initials = first + (subject[0][0] if subject else "")

    def _street(self, tok: list[str], use: list[str], out: Address) -> None:
        n = len(tok)
        for i in range(n):
            if use[i] or out.street:
                continue
            w = tok[i]
            glued = next((g for g in GLUED_STREETS if w.endswith(g) and len(w) - len(g) >= 4), "")
            if glued and self.kind(w) != "street" and (len(glued) > 2 or (i + 1 < n and tok[i + 1].isdigit())):
                near = [k for k in (i + 1, i - 1, i + 2, i - 2) if 0 <= k < n and tok[k].isdigit() and not use[k]]
                out.street, use[i] = w[: -len(glued)], "street"
                if near:
                    out.number, use[near[0]] = tok[near[0]], "number"
        for i in range(n):
            if use[i] or out.street or self.kind(tok[i]) != "street":
                continue
            use[i] = "street"
            j = i + 1
            name = self._take(tok, use, j, 1, "street", 2) if j < n and not use[j] and not tok[j].isdigit() else []
            if not name:
                name = self._take(tok, use, i - 1, -1, "street", 1)
            if name:
                out.street = " ".join(name)
            else:
                use[i] = ""


#: Cosine from which on two names of one town are the same whatever the faults; under it the spelling is checked as well.
SURE = 0.8
#: Names of towns and countries that are broadcast to the readers.
MOST_NAMES = 500_000


_kinds_left = NearWords([(w, 1 if len(w) < 5 else 2) for w in dict.fromkeys((*STREET_WORDS, *ORG_WORDS, *GLUED_STREETS)) if len(w) > 1])


@functools.lru_cache(100_000)
def _left_over(words: str) -> bool:
    """Whether a word beside a name can be its misspelt kind or an acronym, with small words or not."""
    rest = [w for w in words.split() if w not in SMALL_WORDS]
    return len(rest) <= 1 and all(len(w) <= 3 or _kinds_left.find(w) >= 0 or any(one_apart(*sorted((w, k), key=len)) for k, _ in _kinds_left.words) for w in rest)


def same_name(a: str, b: str) -> bool:
    """Whether two streets or organisations of one town are one name: up to three typing faults by length, or a misspelt kind left at one end."""
    short, long = sorted((a, b), key=len)
    if len(short) >= 5 and (long.startswith(short) and _left_over(long[len(short) :]) or long.endswith(" " + short) and _left_over(long[: -len(short)])):
        return True
    most = 1 if len(short) < 6 else 2 if len(short) < 12 else 3
    return banded(a, b, most) <= most or (4 <= len(short) < 6 and with_swaps(a, b) <= 1)


def _less(s: str, k: int) -> list[str]:
    """All that is left of a name without k of its letters."""
    return ["".join(x) for x in combinations(s, len(s) - k)] if k <= len(s) else []


def name_keys(s: str) -> set[int]:
    """Keys of a name, of which two that are one by ``same_name`` share one: what is left of it without the letters that
    its faults can touch, for three faults one of four segments that is unharmed, and all that it may be with more at an end.

    Of two names of a length each goes without as many letters as there may be faults; the shorter one goes without as
    many fewer as it is shorter. An exchange of neighbours leaves both alike without one letter.
    """
    n, out = len(s), []
    if n <= 6:
        out += ["1" + x for k in ((0, 1) if n < 6 else (1,)) for x in _less(s, k)]
    if 6 <= n <= 13:
        out += ["2" + x for k in ((0, 1, 2) if n < 12 else (2,)) for x in _less(s, k)]
    if n >= 12:
        out += [f"3{n}:{i}:{s[p : p + m]}" for i, (p, m) in enumerate(segments(n, 3))]
        for size in range(max(12, n - 3), n + 1):
            for i, (p, m) in enumerate(segments(size, 3)):
                out += [f"3{size}:{i}:{s[at : at + m]}" for at in range(max(0, p - 3), min(n - m, p + 3) + 1)]
    if n >= 5:
        out += ["4" + s[:k] for k in range(5, n + 1)] + ["4" + s[k + 1 :] for k in range(n - 5) if s[k] == " "]
    return {zlib.crc32(x.encode()) for x in out}


def listed_town(town: str, hits: list[tuple[str, int]]) -> str | None:
    """Of the listed names at most two faults from a misspelt town the nearest: one fault or exchange of neighbours in
    5 to 9 letters, two faults in longer names."""
    near = [(x, d, name) for name, d in hits if (x := d if d <= 1 else with_swaps(town, name)) <= 1 or (len(town) >= 10 and d <= 2)]
    return min(near)[2] if near else None


class Lists:
    """Lists of towns and countries with the reader and the tree made of them, once a worker."""

    def __init__(self, towns: dict[str, str], countries: dict[str, str]):
        self.towns, self.countries = towns, countries
        self.made: tuple[AddressReader, BKTree] | None = None

    def __getstate__(self):
        return self.towns, self.countries

    def __setstate__(self, state):
        self.__init__(*state)

    def make(self) -> tuple[AddressReader, BKTree]:
        if self.made is None:
            self.made = AddressReader(set(self.towns), self.countries), BKTree(list(self.towns))
        return self.made


def read_addresses(df: DataFrame, id_col: str, text_col: str, towns: dict[str, str], countries: dict[str, str]) -> DataFrame:
    """(id, town, country, postcode, org, initials, acronym, street, number) of each row that names an organisation or a street."""
    shared = df.sparkSession.sparkContext.broadcast(Lists(towns, countries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shared.value.towns
        reader, tree = shared.value.make()
        for pdf in batches:
            read = [reader.read(v) for v in pdf["value"]]
            lost = sorted({a.town for a in read if a.town and a.town not in names})
            found = {}
            for t, hits in zip(lost, tree.search(lost, [2 if len(t) >= 5 else 0 for t in lost])):
                if name := listed_town(t, hits):
                    found[t] = name
            rows = [(i, names.get(t := found.get(a.town, a.town), t), a.country, a.postcode, a.org, a.initials, a.acronym, a.street, a.number) for i, a in zip(pdf["id"], read)]
            yield pd.DataFrame(rows, columns=["id", "town", "country", "postcode", "org", "initials", "acronym", "street", "number"]).replace({"": None})

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("value")).filter("value is not null")
    text = "town string, country string, postcode string, org string, initials string, acronym string, street string, number string"
    out = src.mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, {text}")
    return out.filter("org is not null or (street is not null and number is not null) or (acronym is not null and town is not null)")


def _clusters(rows: DataFrame, block: list[str], name: str, least: float) -> DataFrame:
    """(block columns, name, root): names of one block that are spellings of one another have one root."""
    distinct = rows.select(*block, name).filter(" and ".join(f"{c} is not null" for c in [*block, name])).distinct()
    keyed = distinct.select(F.concat_ws("\x1f", *block).alias("block"), F.col(name).alias("s"))
    pairs = similar_pairs(keyed, same_name, least, n=0, sure=SURE, near=name_keys)
    node = lambda c: F.concat_ws("\x1e", "block", c)
    roots = components(pairs.select(node("a").alias("a"), node("b").alias("b")))
    keys = distinct.withColumn("node", F.concat_ws("\x1e", F.concat_ws("\x1f", *block), F.col(name)))
    return keys.join(roots, "node", "left").select(*block, name, F.coalesce("root", "node").alias("root"))


def link_sites(df: DataFrame, towns: dict[str, str], countries: dict[str, str], id_col: str = "id", text_col: str = "value", least: float = 0.4) -> DataFrame:
    """(id, site, country): the site of each record that denotes one.

    ``towns``: folded spellings of towns to their folded names; ``countries``: folded names and codes to codes. A record
    delivered twice counts once; null and blank values and those naming neither an organisation nor a street denote no
    site. A record without a street goes to the one street address of its organisation in its town; if there are several,
    to the one with its postal code, or else the one most records give.
    """
    rows = cut(read_addresses(once(df, id_col), id_col, text_col, towns, countries).withColumn("town", F.coalesce("town", F.concat(F.lit("#"), "postcode"))))
    streets = _clusters(rows, ["town", "number"], "street", least).withColumnRenamed("root", "place")
    orgs = _clusters(rows, ["town"], "org", least).withColumnRenamed("root", "body")
    rows = rows.join(streets, ["town", "number", "street"], "left").join(orgs, ["town", "org"], "left")
    rows = cut(rows.select("id", "town", "country", "postcode", "initials", "acronym", "place", "body"))
    # an acronym stands for the organisation of the town that alone has its initials
    short = rows.filter("body is not null and initials is not null").select("town", F.col("initials").alias("acronym"), "body").distinct()
    short = short.groupBy("town", "acronym").agg(F.count(F.lit(1)).alias("n"), F.first("body").alias("meant")).filter("n = 1").drop("n")
    rows = rows.join(short, ["town", "acronym"], "left").withColumn("body", F.coalesce("body", "meant", F.concat_ws("\x1d", "town", "acronym"))).drop("meant")
    held = rows.filter("body is not null and place is not null").groupBy("body", "place").agg(F.count(F.lit(1)).alias("n"), F.collect_set("postcode").alias("codes"))
    held = held.withColumn("rank", F.row_number().over(Window.partitionBy("body").orderBy(F.col("n").desc(), "place")))
    main = held.filter("rank = 1").select("body", F.col("place").alias("main"))
    coded = held.select("body", F.explode("codes").alias("postcode"), "place").groupBy("body", "postcode").agg(F.count(F.lit(1)).alias("n"), F.first("place").alias("coded")).filter("n = 1").drop("n")
    rows = rows.join(main, "body", "left").join(coded, ["body", "postcode"], "left")
    return rows.select("id", F.coalesce("place", "coded", "main", "body").alias("site"), "country").filter("site is not null")


def site_pairs(sites: DataFrame) -> DataFrame:
    """(id_a, id_b), a < b: all pairs of records of one site, but for those that name different countries."""
    a = sites.select("site", F.col("id").alias("id_a"), F.col("country").alias("ca"))
    b = sites.select("site", F.col("id").alias("id_b"), F.col("country").alias("cb"))
    return a.join(b, "site").filter("id_a < id_b and (ca = cb or ca is null or cb is null)").select("id_a", "id_b")


def town_names(places: DataFrame, name_cols: list[str], names_col: str) -> dict[str, str]:
    """Folded spellings of places to their folded names, for a list of checked size."""
    held = places.select(*name_cols, names_col).limit(MOST_NAMES + 1).collect()
    if len(held) > MOST_NAMES:
        raise ValueError("more places than may be broadcast")
    out: dict[str, str] = {}
    main = {plain(r[0]) for r in held}
    for r in held:
        for n in [*(r[c] for c in name_cols), *(r[names_col] or "").split(",")]:
            if n and (k := plain(n)):
                out.setdefault(k, k if k in main else plain(r[0]))
    return out
