"""Text functions on columns."""

from __future__ import annotations

import difflib
import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "abbreviations", "alpha_share", "clean_scan", "clean_title", "cyrillic_to_latin", "deburr", "decode_digits", "doi_prefix", "encode_digits", "expand_tokens", "find_doi", "find_units", "find_year",
    "first_name_keys", "first_token_kind", "french_tokens", "gender_label", "greek_share", "humanize", "inverted_to_text", "keyword_fields", "label_key", "line_filter", "name_variants", "normalize_affiliation", "normalize_term",
    "organisation_name", "page_count", "partial_ratio", "quantities", "ratio", "sentences", "singularize", "strip_marks", "truncate_text", "uniformize", "upper_words", "without_greek",
]

#: Letters that fold to more than one letter or have no decomposition.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
#: Single letters without a decomposition.
PLAIN = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i"}


@functools.cache
def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    pairs = dict(PLAIN)
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(cp))[0]
        if base.isascii() and base.isalpha() and chr(cp) not in LIGATURES:
            pairs.setdefault(chr(cp), base)
    return "".join(pairs), "".join(pairs.values())


def deburr(c: Column) -> Column:
    """Latin letters without their accents; combining marks go, ligatures are written out."""
    out = F.translate(c, *_fold_table())
    for letter, plain in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.regexp_replace(out, "[\\u0300-\\u036f]", "")


def strip_marks(c: Column) -> Column:
    """Any script without its combining marks, by a vectorised function (the slower, complete form of deburr)."""
    f = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch))), "string")
    return f(c)


def upper_words(c: Column) -> Column:
    """Upper-case words, with one space wherever punctuation or white space stood."""
    return F.upper(F.trim(F.regexp_replace(c, "[^\\p{L}\\p{N}]+", " ")))


def normalize_term(c: Column) -> Column:
    """A term without accents and punctuation, in upper case."""
    return upper_words(deburr(c))


def label_key(c: Column) -> Column:
    """The key of a label: no punctuation, no white space, no accents, lower case."""
    return F.lower(deburr(F.regexp_replace(c, "[\\p{P}\\p{S}\\s]+", "")))


def uniformize(c: Column) -> Column:
    """Lower-case letters and digits without accents, separated by one space."""
    return F.trim(F.regexp_replace(F.lower(deburr(c)), "[^a-z0-9]+", " "))


def normalize_affiliation(c: Column) -> Column:
    """An affiliation for comparison: uniform, with shortened common words and without the country's name."""
    words = F.split(uniformize(c), " ")
    short = F.transform(words, lambda w: F.when(w.isin("universite", "university", "universitaire"), "univ").when(w.isin("centre", "center"), "ctr").otherwise(w))
    return F.array_join(F.filter(short, lambda w: ~w.isin("france", "franc", "fr", "")), " ")


def find_doi(c: Column) -> Column:
    """The first digital identifier in a text in lower case; a preprint number gives its registered identifier; else null."""
    doi = F.regexp_extract(c, "(?i)\\b(10\\.\\d{4,9}/[^\\s\"<>]+?)[.,;)\\]]*(?=\\s|$)", 1)
    arxiv = F.regexp_extract(c, "(?i)arxiv[:\\s./a-z]*?(\\d{4}\\.\\d{4,5})", 1)
    return F.when(doi != "", F.lower(doi)).when(arxiv != "", F.concat(F.lit("10.48550/arxiv."), arxiv))


def doi_prefix(c: Column) -> Column:
    """The registrant's part of an identifier or of its address."""
    parts = F.filter(F.split(c, "/"), lambda p: p.rlike("^10\\."))
    return F.try_element_at(parts, F.lit(-1))


def find_year(c: Column) -> Column:
    """The first year of 1900 to 2099 in a text, or null."""
    return F.nullif(F.regexp_extract(c, "(?<!\\d)((?:19|20)\\d{2})(?!\\d)", 1), F.lit("")).cast("int")


def clean_title(c: Column) -> Column:
    """A title without markup and without the notice of its retraction."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]{1,60}>", ""), "(?i)^\\s*(?:retracted(?: article)?|retraction(?: note)?|withdrawn)\\s*:\\s*", ""))


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity; vectorised over distinct pairs of a batch."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        @functools.lru_cache(100_000)
        def one(p, q):
            return difflib.SequenceMatcher(None, p, q).ratio()

        return pd.Series([None if p is None or q is None else one(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def _common(p: str, q: str) -> int:
    """The length of the longest common subsequence, over the bits of a number."""
    masks: dict[str, int] = {}
    for i, s in enumerate(p):
        masks[s] = masks.get(s, 0) | 1 << i
    full = v = (1 << len(p)) - 1
    for s in q:
        if s in masks:
            u = v & masks[s]
            v = (v + u | v - u) & full
    return len(p) - v.bit_count()


def partial_ratio(a: Column, b: Column) -> Column:
    """The best similarity of the shorter text with any stretch of the longer one of its length."""

    def one(p: str, q: str) -> float:
        short, long = (p, q) if len(p) <= len(q) else (q, p)
        if not short:
            return 0.0
        if short in long:
            return 1.0
        starts = {max(0, block.b - block.a) for block in difflib.SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()}
        parts = [long[at : at + len(short)] for at in starts]
        best = 0.0
        # a similarity never exceeds what the longest common subsequence would give
        for most, part in sorted(((2 * _common(short, x) / (len(short) + len(x)), x) for x in parts), reverse=True):
            if most <= best:
                break
            best = max(best, difflib.SequenceMatcher(None, short, part, autojunk=False).ratio())
        return best

    return F.pandas_udf(lambda x, y: pd.Series([None if p is None or q is None else one(p, q) for p, q in zip(x, y)], dtype="float64"), "double")(a, b)


def find_units(c: Column) -> Column:
    """All codes of joint research units in a text, without spaces, each once."""
    found = F.regexp_extract_all(F.lower(c), F.lit("\\b(u[amsrp]{1,3} ?[0-9]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit(""))))


#: Words of private companies, and beginnings of words of public bodies.
PRIVATE_WORDS = ("sas", "sarl", "sa", "private", "edf", "orange")
PUBLIC_STARTS = ("univ", "hop", "hôp", "hosp", "uar", "umr", "cea", "cnrs")


def first_token_kind(c: Column, private: tuple[str, ...] = PRIVATE_WORDS, public: tuple[str, ...] = PUBLIC_STARTS, default: str = "n/a") -> Column:
    """``private`` or ``public`` by the first word of an affiliation that tells, else the default; commas are left out
    and points and brackets at the ends of words do not count."""
    words = F.transform(F.split(F.replace(F.lower(c), F.lit(","), F.lit("")), "\\s+"), lambda w: F.btrim(w, F.lit("().")))
    first = F.try_element_at(F.filter(words, lambda w: w.isin(*private) | w.rlike("^(?:" + "|".join(public) + ")")), F.lit(1))
    return F.when(first.isin(*private), "private").when(first.isNotNull(), "public").otherwise(default)


def organisation_name(c: Column) -> Column:
    """What stands before the first comma of an affiliation, in lower case."""
    return F.trim(F.substring_index(F.lower(c), ",", 1))


#: Codes of a list of first names and the labels they stand for.
GENDERS = {"M": "masculin", "1M": "mixte_masculin", "?M": "mixte_masculin", "F": "feminin", "1F": "mixte_feminin", "?F": "mixte_feminin", "?": "mixte"}


def first_name_keys(c: Column) -> Column:
    """The keys under which a first name is looked up, best first: a double name whole, then its first part; none for initials."""
    name = F.replace(c, F.lit("'"), F.lit(""))
    initials = name.rlike("^([A-Z][. '-]+){2,}[A-Z]*") | name.rlike("^[A-Z]+\\b\\.?")
    parts = F.split(F.replace(F.replace(F.lower(deburr(name)), F.lit("."), F.lit("")), F.lit("- "), F.lit("-")), "[,\\s-]+")
    one, two = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    whole = F.array(F.concat(one, two), F.concat(one, F.lit("-"), two), F.concat(one, F.lit(" "), two), one)
    keys = F.when(F.size(parts) == 1, F.array(one)).when((F.length(one) > 1) & (F.length(two) > 1), whole).when(F.length(one) > 1, F.array(one))
    return F.when(c.isNotNull() & ~initials, F.coalesce(keys, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def gender_label(code: Column, default: str = "n/a") -> Column:
    """The label of a list's code."""
    out = F.lit(default)
    for k, label in GENDERS.items():
        out = F.when(code == k, label).otherwise(out)
    return out


def expand_tokens(c: Column, table: dict[str, str]) -> Column:
    """Words written out by a table, a comma behind a word being kept."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def one(w: Column) -> Column:
        bare = F.lower(F.regexp_replace(w, "[.,]+$", ""))
        return F.when(F.map_contains_key(lookup, bare), F.concat(F.element_at(lookup, bare), F.when(w.endswith(","), ",").otherwise(""))).otherwise(w)

    return F.array_join(F.transform(F.split(c, "\\s+"), one), " ")


def name_variants(first: Column, last: Column) -> Column:
    """The ways a person's name is written: both orders, with initial, with comma."""
    f, x = F.trim(first), F.trim(last)
    ini = F.substring(f, 1, 1)
    forms = [F.concat(f, F.lit(" "), x), F.concat(x, F.lit(" "), f), F.concat(x, F.lit(", "), f), F.concat(ini, F.lit(". "), x), F.concat(x, F.lit(" "), ini), F.concat(x, F.lit(", "), ini, F.lit("."))]
    return F.array_distinct(F.filter(F.array(*forms), lambda v: v.isNotNull()))


#: Small Cyrillic letters in Latin script by ISO 9; those of two signs; letters that look alike in both
#: scripts; a Roman numeral in letters of either.
CYRILLIC = "абвгдђѓеёєжзийіїклмноөпрстћќуўфхцчшщъыьѣэюяѧѵӓӑӕғһӗӡӣӥҡқӄԛԡңӊҥԋԣӈӧӫҩҧҫҭӱӯӳүԝҹӹӛ"
LATIN = "abvgdğǵeëêžzijìïklmnoôprstćḱuŭfhcčšŝʺyʹěèûâǎỳäăæġḥĕźīîǩķḳqļņṇṅǹńňöőòṕșțüūűùwĉÿà"
CYRILLIC_TWO = {"ј": "ǰ", "ґ": "g̀", "ѕ": "ẑ", "љ": "ľ", "њ": "n̂", "џ": "d̆", "җ": "ž̧", "ӝ": "z̄", "ӂ": "z̆", "ҙ": "z̦", "ӟ": "z̈", "ҝ": "k̂", "ҟ": "k̄", "ԥ": "p̀", "ԏ": "t̀", "ұ": "u̇", "ҳ": "h̦", "ҵ": "c̄", "ҷ": "c̦", "ӌ": "c̣", "ӵ": "c̈", "ҽ": "c̆", "ҿ": "c̨̆", "ә": "a̋"}
LOOK_LATIN, LOOK_CYRILLIC = "AaBEeHIiJjKMOoPpCcTYXy", "АаВЕеНІіЈјКМОоРрСсТУХу"
ROMAN = "(?U)\\b([CСMМ]*[XVIХІ]+)\\b"


def cyrillic_to_latin(c: Column) -> Column:
    """Cyrillic text in Latin letters by ISO 9. Letters of Roman numerals become Latin; Latin letters elsewhere that look
    like Cyrillic ones are taken for these."""

    def plain(x: Column) -> Column:
        out = F.translate(F.translate(x, LOOK_LATIN, LOOK_CYRILLIC), CYRILLIC + CYRILLIC.upper(), LATIN + LATIN.upper())
        for letter, two in CYRILLIC_TWO.items():
            out = F.replace(F.replace(out, F.lit(letter), F.lit(two)), F.lit(letter.upper()), F.lit(two.upper()))
        return out

    parts = F.split(F.regexp_replace(c, ROMAN, "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.translate(x, LOOK_CYRILLIC, LOOK_LATIN)).otherwise(plain(x))), "")


def greek_share(c: Column) -> Column:
    """The share of Greek letters among the signs that are no white space; null for a blank text."""
    solid = F.length(F.regexp_replace(c, "\\s+", ""))
    return F.when(solid > 0, F.regexp_count(c, F.lit("[\\u0370-\\u03E1\\u03F0-\\u03FF]")) / solid)


def without_greek(c: Column, most: float = 0.3) -> Column:
    """A text without the sentences, each up to a full stop, in which the share of Greek letters is ``most`` or more."""
    parts = F.filter(F.split(c, "\\."), lambda x: (F.trim(x) != "") & (F.coalesce(greek_share(x), F.lit(0.0)) < most))
    return F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit("."))), "")


#: Faults of scanned official journals and what is put in their place, in this order.
SCAN_FAULTS = (("\n", " "), ("¬ ", ""), ("l'", "l' "), ("d'", "d' "), ("1° ", ""), ("2° ", ""), ("3° ", ""), ("Art. ", ""), (", A", ", a"))


def clean_scan(c: Column) -> Column:
    """The text of a scanned official journal without article numbers, rows of points and known faults."""
    out = F.regexp_replace(F.regexp_replace(c, "\\bArt. \\w*\\b", ""), "\\.\\.+", "")
    for old, new in SCAN_FAULTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def alpha_share(c: Column) -> Column:
    """The share of letters, digits and spaces in a line; null for an empty one."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit("[\\p{L}\\p{N}\\s]")) / F.length(c))


def line_filter(c: Column, least: float = 0.8) -> Column:
    """The lines of a page worth keeping: text enough, no address or identifier, nothing from the references on; no [n]."""
    lines = F.split(c, "\\r?\\n")
    stop = F.transform(lines, lambda x: x.rlike("(?i)^\\s*(?:references|références|bibliography|bibliographie|literatur|bibliografia|bibliografía|referencias|referências)\\s*$"))
    at = F.array_position(stop, True).cast("int")
    kept = F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines)
    good = F.filter(kept, lambda x: (F.length(F.trim(x)) > 0) & (F.coalesce(alpha_share(x), F.lit(0.0)) >= least) & ~x.rlike("(?i)https?://|\\bdoi\\b|\\b10\\.\\d{4,}/"))
    return F.transform(good, lambda x: F.trim(F.regexp_replace(x, "\\[\\d+(?:[,;–-]\\s?\\d+)*\\]", "")))


def french_tokens(c: Column) -> Column:
    """Words with elisions and the punctuation at their edges split off."""
    spaced = F.regexp_replace(F.regexp_replace(c, "(?i)(?<![\\p{L}\\p{N}])([cdjlmnstç]|qu|jusqu|lorsqu|puisqu)['’]", "$1' "), "([.,;:!?()\\[\\]«»\"])", " $1 ")
    return F.filter(F.split(F.trim(spaced), "\\s+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Sentences: a stop, exclamation or question mark before white space and a capital or figure ends one."""
    return F.filter(F.transform(F.split(c, "(?<=[.!?])\\s+(?=[\\p{Lu}\\p{N}])|\\n{2,}"), lambda s: F.trim(s)), lambda s: s != "")


#: Figures as words, with marks that let the text be read back.
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def encode_digits(c: Column, prefix: str = "inf", suffix: str = "sup") -> Column:
    """Every figure as a word between marks, so that tools for words leave it alone."""
    for d, w in enumerate(DIGIT_WORDS):
        c = F.replace(c, F.lit(str(d)), F.lit(f"{prefix}{w}{suffix}"))
    return c


def decode_digits(c: Column, prefix: str = "inf", suffix: str = "sup") -> Column:
    """The inverse of encode_digits."""
    for d, w in enumerate(DIGIT_WORDS):
        c = F.replace(c, F.lit(f"{prefix}{w}{suffix}"), F.lit(str(d)))
    return c


#: Endings of English plurals and their singulars, first match wins.
PLURALS = (("(?i)(ss|us|is)$", "$1"), ("(?i)([^aeiou])ies$", "$1y"), ("(?i)(x|ch|sh|ss|zz)es$", "$1"), ("(?i)(ive)s$", "$1"), ("(?i)([lr])ves$", "$1f"), ("(?i)s$", ""))


def singularize(c: Column) -> Column:
    """An English word in the singular, by its ending."""
    out = c
    for pattern, to in reversed(PLURALS):
        out = F.when(c.rlike(pattern), F.regexp_replace(c, pattern, to)).otherwise(out)
    return out


def humanize(c: Column) -> Column:
    """A keyword for reading: no punctuation, last word in the singular, first letter large."""
    text = F.trim(F.regexp_replace(c, "[\\p{P}\\p{S}\\s]+", " "))
    words = F.split(F.lower(text), " ")
    last = singularize(F.element_at(words, -1))
    joined = F.trim(F.concat_ws(" ", F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "), last))
    return F.when(c.isNotNull(), F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined))))


#: Signs that are dropped before abbreviations are looked for.
ABBREVIATION_NOISE = ".\"',:[]{}?!\\+*ʼ·•"


def abbreviations(c: Column, loose: bool = True) -> Column:
    """Abbreviations in brackets, with as many words before them as they have signs: array of (short, long).

    Those of figures only, with an underscore or of one sign are no abbreviations; unless ``loose``, neither are those
    without a capital, or longer than two signs with one capital only.
    """
    text = c
    for old, new in (("-(", " ("), (")-", ") "), ("((", "("), ("))", ")"), ("(", " ("), (")", ") "), ("/", " "), ("\u2009", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.translate(text, ABBREVIATION_NOISE, "")
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")

    def short(w: Column) -> Column:
        return F.regexp_extract(w, "^\\(([\\p{L}\\p{N}_&-]{2,})\\)$", 1)

    def good(w: Column) -> Column:
        x = short(w)
        ok = (x != "") & ~x.rlike("^\\d+$") & ~x.contains("_")
        return ok if loose else ok & (F.regexp_count(x, F.lit("\\p{Lu}")) >= F.when(F.length(x) > 2, 2).otherwise(1))

    def one(w: Column, i: Column) -> Column:
        n = F.least(F.length(short(w)), i)
        return F.when(good(w), F.struct(short(w).alias("short"), F.array_join(F.slice(words, i - n + 1, n), " ").alias("long")))

    return F.filter(F.transform(words, one), lambda x: x.isNotNull())


#: Units of measurement by kind.
UNITS = {"length": "nm|µm|mm|cm|km|m", "mass": "mg|kg|g", "time": "ms|min|h|s|months?|years?|days?", "temperature": "°C|degrees|K", "share": "%|percent|per cent", "energy": "kJ|eV|J"}


def quantities(c: Column) -> Column:
    """Quantities with their units: array of (quantity, unit, kind)."""
    every = "|".join(UNITS.values())
    found = F.regexp_extract_all(c, F.lit(f"(?<![\\p{{L}}\\d.-])(\\d+(?:[.,]\\d+)?\\s?(?:{every}))(?![\\p{{L}}\\d])"), F.lit(1))

    def one(m: Column) -> Column:
        unit = F.trim(F.regexp_replace(m, "^[\\d.,]+", ""))
        kind = F.lit(None).cast("string")
        for name, units in UNITS.items():
            kind = F.when(unit.rlike(f"^(?:{units})$"), name).otherwise(kind)
        return F.struct(F.regexp_extract(m, "^[\\d.,]+", 0).alias("quantity"), unit.alias("unit"), kind.alias("kind"))

    return F.transform(found, one)


def keyword_fields(c: Column, field: str = "keywords") -> Column:
    """The quoted or bare values that a search expression gives a field."""
    found = F.regexp_extract_all(c, F.lit(f'{field}(?:\\.\\w+)*:\\s*("[^"]*"|[^\\s()"]+)'), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))


def page_count(c: Column) -> Column:
    """Pages of a range such as 12-19 (also the wrong way round); 1 for a single page; null for anything else."""
    a, b = (F.nullif(F.regexp_extract(c, "^\\s*(\\d+)\\s*(?:[-–]\\s*(\\d+))?\\s*$", k), F.lit("")).cast("bigint") for k in (1, 2))
    return F.when(b.isNotNull(), F.abs(b - a) + 1).when(a.isNotNull(), F.lit(1).cast("bigint"))


def inverted_to_text(c: Column) -> Column:
    """A text from its inverted index, a map of words to their positions."""
    spots = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(spots), lambda s: s["w"]), " ")


def truncate_text(c: Column, most: int, seed: int = 0) -> Column:
    """At most ``most`` signs of a long text, its paragraphs in an order set by a seeded hash; the last, cut line goes."""
    parts = F.split(c, "\\n+")
    order = F.array_sort(F.transform(parts, lambda p: F.struct(F.xxhash64(p, F.lit(seed)).alias("h"), p.alias("p"))))
    cut = F.substring(F.array_join(F.transform(order, lambda s: s["p"]), "\n"), 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.regexp_replace(cut, "\\n[^\\n]*$", ""))
