"""Functions on dates, numbers, maps, JSON and derived fields of bibliographic records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "any_of", "collation", "earlier_year", "edit_json", "fallback_urls", "has_path", "is_equal", "kept_codes", "label_or_own", "now", "parse_json", "penalised", "rename_keys", "source_chain",
    "stringify", "to_fixed", "weighted_similarity", "without_before", "year_of",
]


def year_of(c: Column) -> Column:
    """The year of a date written year first, or null."""
    return F.regexp_extract(c.cast("string"), "^\\s*(\\d{4})(?:\\D|$)", 1).try_cast("int")


def earlier_year(a: Column, b: Column, default: str = "9999") -> Column:
    """The year of the earlier of two dates, as four signs; the default where neither is known."""
    known = lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(default))
    return F.substring(F.least(known(a), known(b)), 1, 4)


def any_of(c: Column) -> Column:
    """Whether an array holds anything but nulls and empty strings."""
    return F.coalesce(F.exists(c, lambda x: x.isNotNull() & (x.cast("string") != "")), F.lit(False))


def kept_codes(own: Column, outer: Column, fallback: Column, blocked: tuple[str, ...] = ()) -> Column:
    """Distinct codes of two arrays without nulls and empty ones; where there are none, those of a third without the blocked ones."""
    empty = F.array().cast("array<string>")
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(c, empty), lambda x: x.isNotNull() & (x != "")))
    found = F.array_union(clean(own), clean(outer))
    rest = F.filter(clean(fallback), lambda x: ~x.isin(*blocked)) if blocked else clean(fallback)
    return F.when(F.size(found) > 0, found).otherwise(rest)


def without_before(c: Column, dropped: str, follower: str) -> Column:
    """An array without the elements ``dropped`` that stand right before ``follower``."""
    return F.filter(c, lambda x, i: ~((x == dropped) & F.coalesce(F.get(c, i + 1) == follower, F.lit(False))))


def collation(volume: Column, issue: Column, pages: Column) -> Column:
    """Volume, issue and pages with strokes between those that are known."""
    return F.array_join(F.filter(F.array(volume, issue, pages), lambda x: x.isNotNull() & (F.trim(x) != "")), " / ")


def source_chain(c: Column, separator: str = ">") -> Column:
    """The parts of a chain of sources, trimmed, each once, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != ""))


def fallback_urls(own: Column, others: Column) -> Column:
    """A record's own URLs, or where it has none those of other places, each once."""
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")))
    return F.when(F.size(clean(own)) > 0, clean(own)).otherwise(clean(others))


def label_or_own(found: Column, own: Column, missing: str = "n/a") -> Column:
    """A looked-up label, or the original value where the lookup missed."""
    return F.when(found.isNull() | (found == missing), own).otherwise(found)


def penalised(p: Column, frequency: Column, rate: float = 0.4) -> Column:
    """A probability held down for classes that were seldom seen."""
    return (1 - F.exp(-rate * frequency)) * p


def weighted_similarity(similarity: Column, weight: Column) -> Column:
    """Four fifths similarity, one fifth the term's weight."""
    return 0.8 * similarity + 0.2 * weight


def rename_keys(c: Column, old: str, new: str) -> Column:
    """A map with a piece of text in its keys replaced."""
    return F.transform_keys(c, lambda k, v: F.replace(k, F.lit(old), F.lit(new)))


def edit_json(c: Column, pattern: str, new: str, schema: str) -> Column:
    """A struct or map changed by a pattern over its JSON text."""
    return F.from_json(F.regexp_replace(F.to_json(c), pattern, new), schema)


def stringify(c: Column) -> Column:
    """A struct, array or map as JSON text."""
    return F.to_json(c)


def parse_json(c: Column, schema: str) -> Column:
    """JSON text as a value of a schema; null for text that is none."""
    return F.from_json(c, schema)


def to_fixed(c: Column, digits: int) -> Column:
    """A number as text with so many digits behind the point, half away from zero."""
    return F.round(c.cast("double"), digits).cast(f"decimal(38,{digits})").cast("string")


def now() -> Column:
    return F.current_timestamp()


def has_path(c: Column) -> Column:
    """Whether there is a value at a path."""
    return c.isNotNull()


def is_equal(a: Column, b: Column) -> Column:
    """Equality in which two nulls are equal; arrays and structs are compared whole."""
    return a.eqNullSafe(b)
