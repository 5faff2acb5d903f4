"""Joins: lookups with a default, resolvers of two hops, ranges, similarity and containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import label_key, ratio
from corpusloom.session import spread


def lookup(df: DataFrame, table: DataFrame, on: str, key: str, value: Column, order: Column | None = None, default=None, name: str = "result") -> DataFrame:
    """Left lookup in which the first match wins; keys are looked up once each. A miss gets the default."""
    first = table.groupBy(F.col(key).alias(on)).agg(F.min_by(value, order if order is not None else value).alias(name))
    out = df.join(first, on, "left")
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def lookup_any(df: DataFrame, table: DataFrame, id_col: str, candidates: Column, key: str, value: str, default=None, name: str = "result") -> DataFrame:
    """Lookup under several keys in the order of an array: the first that is known wins."""
    tried = df.select(id_col, F.posexplode(candidates).alias("_rank", key))
    hits = tried.join(table.select(key, value), key).groupBy(id_col).agg(F.min_by(value, "_rank").alias(name))
    out = df.join(hits, id_col, "left")
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def flag_member(df: DataFrame, members: DataFrame, on: str, name: str = "member") -> DataFrame:
    """Whether a value is in a list, as a boolean."""
    known = members.select(F.col(members.columns[0]).alias(on)).distinct().withColumn("_in", F.lit(True))
    return df.join(known, on, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def flag_members(df: DataFrame, members: DataFrame, id_col: str, array_col: str, name: str = "members") -> DataFrame:
    """For an array column, which of its elements are in a list, in their order."""
    rows = df.select(id_col, F.posexplode(array_col).alias("_at", "_x"))
    known = members.select(F.col(members.columns[0]).alias("_x")).distinct().withColumn("_in", F.lit(True))
    back = rows.join(known, "_x", "left").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_in", F.lit(False)).alias("f")))).alias("_f"))
    return df.join(back.select(id_col, F.transform("_f", lambda s: s["f"]).alias(name)), id_col, "left")


def resolve(df: DataFrame, labels: DataFrame, concepts: DataFrame, column: str, default: str = "n/a") -> DataFrame:
    """Two hops: the label's key gives a concept's uri, the uri its concept. Adds uri and preferred label.

    ``labels``: label, uri. ``concepts``: uri, label. Several labels of one key give the least uri.
    """
    index = labels.select(label_key(F.col("label")).alias("_key"), "uri").groupBy("_key").agg(F.min("uri").alias("uri"))
    hit = df.withColumn("_key", label_key(F.col(column))).join(index, "_key", "left")
    return hit.join(concepts.select("uri", F.col("label").alias("concept")), "uri", "left").withColumn("concept", F.coalesce("concept", F.lit(default))).drop("_key")


def broader(concepts: DataFrame, parents: DataFrame, hops: int = 2) -> DataFrame:
    """(uri, up1, up2, ...): the chain of broader concepts. ``parents``: uri, parent."""
    out = concepts.select("uri")
    below = "uri"
    for k in range(1, hops + 1):
        step = parents.select(F.col("uri").alias(below), F.col("parent").alias(f"up{k}"))
        out = out.join(step, below, "left")
        below = f"up{k}"
    return out


def in_period(df: DataFrame, table: DataFrame, on: str, year: str, start: str, end: str, value: str) -> DataFrame:
    """Join on a key and a year within [start, end], an open end being null; the structure that began last wins."""
    rows = df.join(table, on, "left").filter(F.col(value).isNull() | ((F.col(start) <= F.col(year)) & (F.col(end).isNull() | (F.col(year) <= F.col(end)))))
    return rows


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """For each left row the value of the last right row of its key that is not later. One sort, no range join."""
    a = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    b = right.select(by, F.col(right_time).alias("_t"), value).withColumn("_side", F.lit(0))
    w = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return both.filter("_side = 1").drop("_t", "_side")


def blocked_similarity(df: DataFrame, id_col: str, text_col: str, prefix: int = 3, least: float = 0.8) -> DataFrame:
    """(a, b, score): pairs whose texts share their first letters and are alike; texts are compared once each."""
    texts = df.select(F.col(text_col).alias("t")).filter("t is not null and t != ''").distinct().withColumn("_block", F.substring(F.lower("t"), 1, prefix))
    a, b = texts.select("_block", F.col("t").alias("ta")), texts.select("_block", F.col("t").alias("tb"))
    return a.join(b, "_block").filter("ta < tb and abs(length(ta) - length(tb)) <= (1 - %f) * 2 * greatest(length(ta), length(tb))" % least).withColumn("score", ratio(F.col("ta"), F.col("tb"))).filter(F.col("score") >= least).select("ta", "tb", "score")


def contained_terms(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_col: str) -> DataFrame:
    """(id, term, at, n): dictionary terms in texts, by equality of word runs rather than by search; ``at`` is the word's
    place. The lengths of runs are those that the dictionary has, whatever they are."""
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))
    listed = terms.select(tidy(F.col(term_col)).alias("term")).filter("term != ''").distinct().withColumn("n", F.size(F.split("term", " ")))
    sizes = listed.select("n").distinct()  # no more rows than the longest term has words
    words = texts.select(id_col, F.split(tidy(F.col(text_col)), " ").alias("_w")).join(F.broadcast(sizes), F.expr("n <= size(_w)"))
    runs = words.select(id_col, "n", F.posexplode(F.expr("transform(sequence(1, size(_w) - n + 1), i -> array_join(slice(_w, i, n), ' '))")).alias("at", "term"))
    return runs.join(listed, ["n", "term"]).select(id_col, "term", "at", "n")


def longest_match(matches: DataFrame, id_col: str) -> DataFrame:
    """Of overlapping matches the longest, then the earliest: those stay that no better one overlaps.

    A match is compared with those that begin less than the longest match's length before or behind it, found by a
    window over the places, not with all of its text.
    """
    m = matches.withColumn("_key", F.struct(F.col("n"), -F.col("at")))
    most = matches.agg(F.max("n").alias("n")).first()["n"] or 1
    near = Window.partitionBy(id_col).orderBy("at").rangeBetween(-(most - 1), most - 1)
    others = F.collect_set(F.struct("at", "n")).over(near)
    better = F.exists(others, lambda o: (o["at"] < F.col("at") + F.col("n")) & (F.col("at") < o["at"] + o["n"]) & ((o["n"] > F.col("n")) | ((o["n"] == F.col("n")) & (o["at"] < F.col("at")))))
    return m.filter("_key is not null").withColumn("_better", better).filter("not _better").drop("_better", "_key")


#: Bytes of queries that are sent to every task at once; more go in slices.
MOST_SENT = 1 << 26


def nearest_neighbours(queries: DataFrame, points: DataFrame, id_col: str, vec_col: str, k: int, metric: str = "l2", most: int = MOST_SENT, step: int = 512) -> DataFrame:
    """(query, neighbour, distance, rank): exact k nearest of each query among all points, itself excluded.

    The queries are a stated set; slices of at most about ``most`` bytes go to the tasks one after the other. A task
    reads its points once and keeps the best of each query; only these are shuffled. Points without a vector are none.
    """
    sc = queries.sparkSession.sparkContext
    unit = lambda x: x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True)) if metric == "cosine" else x
    full = lambda d: d.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    asked, src = full(queries), full(points)
    slices = -(-8 * (asked.agg(F.sum(F.size("v"))).first()[0] or 0) // most)
    schema = "query bigint, neighbour bigint, distance double"

    def against(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, x = shared.value
            xx, far = (x * x).sum(1)[:, None], np.iinfo(np.int64).max
            best, who = np.full((len(x), k), np.inf), np.full((len(x), k), far)
            for b in batches:
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    y, ids = unit(np.stack(part.column(1).to_numpy(zero_copy_only=False))), part.column(0).to_numpy()
                    d = 1 - x @ y.T if metric == "cosine" else np.sqrt(np.maximum(0, xx + (y * y).sum(1)[None] - 2 * x @ y.T))
                    d[qid[:, None] == ids[None]] = np.inf
                    d, w = np.concatenate([best, d], 1), np.concatenate([who, np.broadcast_to(ids, d.shape)], 1)
                    order = np.lexsort((w, np.round(d, 9)), axis=-1)[:, :k]
                    best, who = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)
            q, j = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(who[q, j]), pa.array(best[q, j])], names=["query", "neighbour", "distance"])

        return run

    out = queries.sparkSession.createDataFrame([], schema)
    for n in range(slices):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == n).toArrow()
        if part.num_rows:
            shared = sc.broadcast((part.column("id").to_numpy(), unit(np.stack(part.column("v").to_numpy(zero_copy_only=False)))))
            out = out.unionAll(spread(src).mapInArrow(against(shared), schema))
    w = Window.partitionBy("query").orderBy(F.round("distance", 9), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_classes(neighbours: DataFrame, labels: DataFrame, id_col: str, label_col: str, cut_off: float | None = None) -> DataFrame:
    """(query, label, weight): classes of the neighbours weighted by 1 / distance, the heaviest wins; queries whose nearest
    neighbour is farther than ``cut_off`` are dropped."""
    rows = neighbours.join(labels.select(F.col(id_col).alias("neighbour"), F.col(label_col).alias("label")), "neighbour")
    if cut_off is not None:
        rows = rows.join(neighbours.filter(F.col("rank") == 1).filter(F.col("distance") < cut_off).select("query"), "query", "left_semi")
    votes = rows.groupBy("query", "label").agg(F.sum(1 / F.greatest("distance", F.lit(1e-9))).alias("weight"))
    w = Window.partitionBy("query").orderBy(F.round("weight", 9).desc(), "label")
    return votes.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def batched(it: Iterator, size: int) -> Iterator[list]:
    """Lists of ``size`` items, for connectors that ask for many keys at once."""
    part = []
    for x in it:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
