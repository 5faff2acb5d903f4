"""Alignment of notices with texts: matches of their terms, and which of them to believe.

Matches: id, term, at, n (words) and notice. Notices: notice, term, ignored (a term that only counts beside another one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import contained_terms, longest_match
from corpusloom.operators.terms import match_score


def notice_matches(texts: DataFrame, notices: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, at, n, notice): the longest terms of notices in texts, each with every notice that has it."""
    tidy = notices.withColumn("term", F.trim(F.regexp_replace(F.lower("term"), "[^\\p{L}\\p{N}]+", " ")))
    found = longest_match(contained_terms(texts, tidy.select("term"), id_col, text_col, "term"), id_col)
    return found.join(tidy.select("term", "notice").distinct(), "term").select(id_col, "term", "at", "n", "notice")


def span_matches(spans: DataFrame, notices: DataFrame, id_col: str, kind: str = "LOC") -> DataFrame:
    """(id, term, at, n, notice) by the equality of a tagger's entities with the terms of notices."""
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))
    asked = spans.filter(F.col("tag") == kind).select(id_col, tidy("text").alias("term"), F.col("start").alias("at")).withColumn("n", F.size(F.split("term", " ")))
    return asked.join(notices.select(tidy("term").alias("term"), "notice").distinct(), "term").select(id_col, "term", "at", "n", "notice")


def without_ignored(matches: DataFrame, notices: DataFrame) -> DataFrame:
    """Matches without those of an ignored term of a notice of which no other term occurs in any text."""
    used = matches.select("term").distinct()
    here = notices.select("notice", F.col("term").alias("other")).join(used.withColumnRenamed("term", "other"), "other").distinct()
    weak = notices.filter("ignored").select("notice", "term").distinct()
    beside = weak.join(here, "notice").filter("other != term").select("notice", "term").distinct()
    return matches.join(weak.join(beside, ["notice", "term"], "left_anti"), ["notice", "term"], "left_anti")


def believed_notices(matches: DataFrame, id_col: str) -> DataFrame:
    """Of several notices at one place those that most matches of the corpus name, if that is more than one."""
    often = matches.groupBy("notice").agg(F.count(F.lit(1)).alias("_k"))
    place = Window.partitionBy(id_col, "at", "n")
    rows = matches.join(often, "notice").withColumn("_m", F.max("_k").over(place)).withColumn("_s", F.count(F.lit(1)).over(place))
    return rows.filter("_s = 1 or _m = 1 or _k = _m").drop("_k", "_m", "_s")


def scored_notices(matches: DataFrame, notices: DataFrame) -> DataFrame:
    """Matches with a score: how many of the notice's terms occur, and how few notices share the term."""
    terms = matches.groupBy("notice").agg(F.countDistinct("term").alias("_c"))
    all_ = notices.groupBy("notice").agg(F.countDistinct("term").alias("_t"))
    shared = notices.groupBy("term").agg(F.countDistinct("notice").alias("_n"))
    rows = matches.join(terms, "notice").join(all_, "notice").join(shared, "term")
    return rows.withColumn("score", F.round(match_score(F.col("_c"), F.col("_t"), F.col("_n")), 3)).drop("_c", "_t", "_n")
