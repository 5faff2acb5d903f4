"""Resolvers: lookups whose answers are projected, verbalised, ranked or taken from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import uniformize
from corpusloom.operators.joins import resolve

MISSING = "n/a"


def looked_up(df: DataFrame, table: DataFrame, on: Column, key: Column, shape: dict[str, Column], order: Column, name: str = "value") -> DataFrame:
    """Adds what ``shape`` takes of the first record of a register under a key, as a struct; null for a miss. Shapes are how
    versions and variants of one lookup differ."""
    first = table.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*[c.alias(n) for n, c in shape.items()]), order).alias(name))
    return df.withColumn("_k", on).join(first, "_k", "left").drop("_k")


def each_record(df: DataFrame, table: DataFrame, on: Column, key: Column, shape: dict[str, Column]) -> DataFrame:
    """One row for each record of a register under a key; a miss keeps one row with nulls."""
    rows = table.select(key.alias("_k"), *[c.alias(n) for n, c in shape.items()])
    return df.withColumn("_k", on).join(rows, "_k", "left").drop("_k")


def first_path(xml: Column, *paths: str) -> Column:
    """The first text of a document that is not empty, by path."""
    found = [F.nullif(F.trim(F.xpath_string(xml, F.lit(p))), F.lit("")) for p in paths]
    return F.coalesce(*found)


def by_extension(files: Column, *extensions: str) -> Column:
    """Of an array of structs with a field ``extension`` the first one of the first extension that is there."""

    def first(e: str) -> Column:
        return F.get(F.filter(files, lambda f: f["extension"] == e), F.lit(0))

    return F.coalesce(*[first(e) for e in extensions])


def verbalise(df: DataFrame, id_col: str, codes: str, labels: DataFrame, code: str, label: str, name: str = "labels") -> DataFrame:
    """Adds the labels of an array of codes in its order; a code without a label stays as it is."""
    rows = df.select(id_col, F.posexplode(codes).alias("_at", "_c"))
    known = labels.groupBy(F.col(code).alias("_c")).agg(F.min(label).alias("_l"))
    back = rows.join(known, "_c", "left").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_l", "_c").alias("l")))).alias("_v"))
    out = df.join(back.select(id_col, F.transform("_v", lambda v: v["l"]).alias(name)), id_col, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def identify_concepts(df: DataFrame, labels: DataFrame, concepts: DataFrame, column: str, fields: dict[str, Column]) -> DataFrame:
    """Adds fields of the concept that a label names, each the missing sign where there is no concept: the flat answer."""
    out = resolve(df, labels, concepts.select("uri", "label"), column).drop("concept")
    flat = concepts.groupBy("uri").agg(*[F.min(c).alias(n) for n, c in fields.items()])
    return out.join(flat, "uri", "left").select(*df.columns, *[F.coalesce(F.col(n).cast("string"), F.lit(MISSING)).alias(n) for n in fields])


def expand_concepts(df: DataFrame, labels: DataFrame, concepts: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """Adds the whole concept that a label names: uri, label, the labels of what is broader and narrower; null for a miss.
    ``parents``: uri, parent."""
    named = concepts.select("uri", "label")
    up = parents.join(named.withColumnRenamed("uri", "parent"), "parent").groupBy("uri").agg(F.array_sort(F.collect_set("label")).alias("broader"))
    down = parents.join(named, "uri").groupBy(F.col("parent").alias("uri")).agg(F.array_sort(F.collect_set("label")).alias("narrower"))
    empty = F.array().cast("array<string>")
    whole = named.join(up, "uri", "left").join(down, "uri", "left").select("uri", F.struct("uri", "label", F.coalesce("broader", empty).alias("broader"), F.coalesce("narrower", empty).alias("narrower")).alias("concept"))
    return resolve(df, labels, named, column).drop("concept").join(whole, "uri", "left").select(*df.columns, "concept")


def organisation_of(df: DataFrame, register: DataFrame, name: Column, city: Column, key: str, name_col: str, city_col: str, weight: Column) -> DataFrame:
    """Adds the register's entry of that name: one of the same town first, then the heaviest, then the least key. A name
    with a town that no entry of it has gives none."""
    listed = register.select(uniformize(F.col(name_col)).alias("_n"), uniformize(F.col(city_col)).alias("_c"), F.col(key).alias("entry"), weight.alias("_w"))
    per_city = listed.groupBy("_n", "_c").agg(F.min_by("entry", F.struct(-F.col("_w"), F.col("entry"))).alias("_same"))
    best = listed.groupBy("_n").agg(F.min_by("entry", F.struct(-F.col("_w"), F.col("entry"))).alias("_any"))
    rows = df.withColumn("_n", uniformize(name)).withColumn("_c", uniformize(city))
    out = rows.join(per_city, ["_n", "_c"], "left").join(best, "_n", "left")
    return out.withColumn("entry", F.when(F.coalesce(F.length("_c"), F.lit(0)) > 0, F.col("_same")).otherwise(F.col("_any"))).drop("_n", "_c", "_same", "_any")
