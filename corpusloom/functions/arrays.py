"""Array, object and predicate functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["cast_array", "compact", "falsy", "first_of", "get_path", "is_empty", "last_of", "merge_maps", "omit_keys", "pairs_of", "pick_keys", "sliding_pairs", "sort_desc", "truthy", "uniq", "xor"]


def get_path(c: Column, path: str, default=None) -> Column:
    """The value at a dotted path, a number being a position from 0; the default where there is none."""
    for part in path.split("."):
        c = F.get(c, F.lit(int(part))) if part.isdigit() else c[part]
    return c if default is None else F.coalesce(c, F.lit(default))


def falsy(c: Column, kind: str = "string") -> Column:
    """Null, empty string, zero, false and NaN."""
    if kind == "string":
        return c.isNull() | (c == "")
    if kind == "boolean":
        return c.isNull() | ~c
    return c.isNull() | (c == 0) | (F.isnan(c) if kind in ("double", "float") else F.lit(False))


def truthy(c: Column, kind: str = "string") -> Column:
    return ~falsy(c, kind)


def is_empty(c: Column, array: bool = False) -> Column:
    """Whether there is nothing in a string or array."""
    return c.isNull() | (F.size(c) == 0 if array else F.trim(c) == "")


def compact(c: Column, kind: str = "string") -> Column:
    """An array without its falsy elements."""
    return F.filter(c, lambda x: truthy(x, kind))


def uniq(c: Column) -> Column:
    """Distinct elements in the order in which they are first seen."""
    return F.array_distinct(c)


def xor(a: Column, b: Column) -> Column:
    """Elements of either array that are not in the other."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def cast_array(c: Column) -> Column:
    """A single value as an array of one; null as an empty array."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def first_of(c: Column, default=None) -> Column:
    return F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(default))


def last_of(c: Column, default=None) -> Column:
    return F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(default))


def sort_desc(c: Column) -> Column:
    return F.sort_array(c, asc=False)


def pick_keys(c: Column, *keys: str) -> Column:
    return F.map_filter(c, lambda k, v: k.isin(*keys))


def omit_keys(c: Column, *keys: str) -> Column:
    return F.map_filter(c, lambda k, v: ~k.isin(*keys))


def merge_maps(a: Column, b: Column) -> Column:
    """Entries of both maps, those of the second winning."""
    keys = F.map_keys(b)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(keys, k)), b)


def pairs_of(c: Column) -> Column:
    """All unordered pairs of an array's elements, in array order: array of (source, target)."""
    n = F.size(c)
    inner = lambda i: F.transform(F.slice(c, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.struct(F.get(c, i).alias("source"), y.alias("target")))
    return F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), inner))).otherwise(F.array().cast("array<struct<source:string,target:string>>"))


def sliding_pairs(c: Column) -> Column:
    """Each element with the next one."""
    n = F.size(c)
    both = lambda i: F.struct(F.get(c, i).alias("source"), F.get(c, i + 1).alias("target"))
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), both)).otherwise(F.array().cast("array<struct<source:string,target:string>>"))
