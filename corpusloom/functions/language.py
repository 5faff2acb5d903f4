"""Language of a text, lemmas, and the parts of postal addresses, by rules and short lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import expand_tokens, singularize, uniformize

__all__ = ["FUNCTION_WORDS", "address_parts", "detect_language", "expand_address", "language_shares", "lemmas"]

#: Frequent function words that few of the other languages have.
FUNCTION_WORDS = {
    "en": "the of and to is that for with was are this which from by be at it not have".split(),
    "fr": "le les des et est une dans pour que qui sur au par pas plus sont aux cette avec du".split(),
    "de": "der die und das den von ist mit des dem nicht ein eine auf für sich wird im zu werden".split(),
    "es": "el los las y del una para con por se más como su entre está son al lo sobre muy".split(),
    "it": "il gli di che della è per con una dei nel alla delle sono più dal le al anche questo".split(),
    "pt": "o os as do da em um uma não para com dos no na se ao pelo mais são das".split(),
}


def _count(words: Column, lang: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS[lang])))


def language_shares(c: Column) -> Column:
    """A struct with the share of each language's function words among all that a text has; nulls for none."""
    words = F.split(F.lower(c), "[^\\p{L}]+")
    total = sum((_count(words, lang) for lang in FUNCTION_WORDS), F.lit(0))
    return F.struct(*[F.when(total > 0, _count(words, lang) / total).alias(lang) for lang in FUNCTION_WORDS])


def detect_language(shares: Column, least: float = 0.85) -> Column:
    """The language whose share is over ``least``, or an empty string."""
    out = F.lit("")
    for lang in reversed(FUNCTION_WORDS):
        out = F.when(shares[lang] > least, lang).otherwise(out)
    return out


def lemmas(c: Column, known: dict[str, str] | None = None) -> Column:
    """The words of a term or text as lemmas: by a table of irregular ones, else in the singular; stars are spaces."""
    words = F.filter(F.split(F.replace(F.lower(c), F.lit("*"), F.lit(" ")), "\\s+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in (known or {"": ""}).items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), singularize(w))), " ")


#: Shortened words of addresses and what they stand for.
ADDRESS_WORDS = {
    "av": "avenue", "ave": "avenue", "bd": "boulevard", "blvd": "boulevard", "boul": "boulevard", "ch": "chemin", "dept": "department", "dr": "drive", "inst": "institute", "lab": "laboratory",
    "pl": "place", "rd": "road", "rte": "route", "sq": "square", "st": "street", "str": "street", "univ": "university",
}
_ROADS = "street|road|avenue|lane|square|drive|rue|boulevard|route|chemin|place|via|viale|corso|piazza|calle|avenida|plaza|paseo|quai|impasse|allee"


def expand_address(c: Column) -> Column:
    """An address for comparison: uniform words, shortened ones written out."""
    return expand_tokens(uniformize(c), ADDRESS_WORDS)


def address_parts(c: Column) -> Column:
    """(postcode, house_number, road) of an address as far as its writing tells them; nulls for what it does not."""
    text = expand_address(c)
    first = lambda pattern, k=1: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    ahead = f"(?:^| )(\\d{{1,4}}) ((?:{_ROADS})(?: (?:de|du|des|la|le|l|d|di|del|della|y))* [a-z]+)"
    behind = f"(?:^| )((?:{_ROADS})(?: (?:de|du|des|la|le|l|d|di|del|della|y))* [a-z]+) (?:n |no |nr )?(\\d{{1,4}})(?: |$)"
    return F.struct(first("(?:^| )(\\d{5})(?: |$)").alias("postcode"), F.coalesce(first(ahead), first(behind, 2)).alias("house_number"), F.coalesce(first(ahead, 2), first(behind)).alias("road"))
