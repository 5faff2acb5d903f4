"""Composed routes: named pipelines over records in the id/value shape, run at once or as background jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import analytics as A
from corpusloom.operators import terms as X
from corpusloom.operators.dataflow import Params
from corpusloom.operators.learning import topics
from corpusloom.streaming.jobs import Jobs

Route = Callable[[DataFrame, Params], DataFrame]


def _items(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("value").alias("p", "x"))


def _terms(df: DataFrame, p: Params) -> DataFrame:
    return X.specific_terms(df, "id", "value", lang=p.get("lang", "en"), top=p.get("nb", 5), numbers=p.get("numbers", False))


def _term_lists(df: DataFrame, p: Params) -> DataFrame:
    return _terms(df, p).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("value"))


ROUTES: dict[str, Route] = {
    "graph-segment": lambda df, p: A.cooccurrence(_items(df), "id", "x", "p"),
    "tree-segment": lambda df, p: A.transitions(_items(df), "id", "x", ["p"]),
    "group-by": lambda df, p: A.same_value(df, "id", "value"),
    "statistics": lambda df, p: A.statistics(df, F.col("value"), ["id"]),
    "tag-cloud": lambda df, p: A.frequent(_terms(df, p), "term", p.get("least", 2)),
    "teeft": _term_lists,
    "teeft-graph": lambda df, p: A.cooccurrence(_items(_term_lists(df, p)), "id", "x", "p"),
    "terms": lambda df, p: X.minimal_terms(X.corpus_terms(df, "id", "value", p.get("lang", "en"), p.get("top", 500))),
    "lda": lambda df, p: topics(df, "id", "value", k=p.get("k", 5))[0],
    "no-accent": lambda df, p: df.withColumn("value", T.deburr(F.col("value"))),
    "normalize": lambda df, p: df.withColumn("value", T.normalize_term(F.col("value"))),
    "keywords-clean": lambda df, p: df.withColumn("value", T.humanize(F.col("value"))),
    "transliterate": lambda df, p: df.withColumn("value", T.cyrillic_to_latin(F.col("value"))),
}


def run_route(name: str, df: DataFrame, params: Params | None = None) -> DataFrame:
    """The answer of a route at once."""
    return ROUTES[name](df, params or Params())


def submit_route(jobs: Jobs, name: str, df: DataFrame, params: Params | None = None) -> dict[str, str]:
    """The ticket of a route that runs in the background; its result is fetched by ``Jobs.result`` or ``Jobs.export``."""
    return jobs.submit(name, lambda: run_route(name, df, params))
