"""Aggregations and window operators over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.dataflow import with_position


#: Items of a record of which all pairs are made in one row; a longer record is taken in blocks of so many.
BLOCK = 256


def cooccurrence(df: DataFrame, id_col: str, item_col: str, position: str, distinct_ids: bool = True, block: int = BLOCK) -> DataFrame:
    """(source, target, weight, origins): unordered pairs of a record's items in their order, counted over the records.

    ``df``: one row for each item. Empty items count for nothing. Items are numbered by a window and gathered in blocks;
    each block gives its own pairs and meets the later ones of its record, so a record of any length is spread over many
    rows. A pair's count in a record is made first, so origins are a plain sum.
    """
    items = df.filter(F.col(item_col).isNotNull() & (F.col(item_col) != "")).select(id_col, F.col(item_col).alias("_x"), F.col(position).alias("_p"))
    numbered = items.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("_p", "_x")) - 1)
    blocks = numbered.groupBy(id_col, F.floor(F.col("_n") / block).cast("int").alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_x"))), lambda s: s["_x"]).alias("_v"))
    own = F.expr("flatten(transform(sequence(1, size(_v) - 1), i -> transform(slice(_v, i + 1, size(_v)), y -> struct(_v[i - 1] as source, y as target))))")
    within = blocks.filter("size(_v) > 1").select(id_col, F.explode(own).alias("e"))
    more = blocks.filter("_b > 0").select(id_col).distinct()
    long = blocks.join(more, id_col, "left_semi")
    later = long.select(id_col, F.col("_b").alias("_c"), F.col("_v").alias("_w"))
    across = long.join(later, id_col).filter("_b < _c").select(id_col, F.explode(F.expr("flatten(transform(_v, x -> transform(_w, y -> struct(x as source, y as target))))")).alias("e"))
    pairs = within.unionAll(across).select(id_col, "e.source", "e.target")
    if not distinct_ids:
        return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), F.count(id_col).alias("origins"))
    per = pairs.groupBy("source", "target", id_col).agg(F.count(F.lit(1)).alias("_k"))
    return per.groupBy("source", "target").agg(F.sum("_k").alias("weight"), F.count(id_col).alias("origins"))


def keyword_weights(df: DataFrame, id_col: str, item_col: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a keyword graph: a node weighs one and a half times its occurrences; an edge is an unordered pair,
    lesser name first, and weighs its occurrences in one record; lighter ones than ``least`` are left out."""
    nodes = df.filter(F.col(item_col).isNotNull() & (F.col(item_col) != "")).groupBy(F.col(item_col).alias("node")).agg((1.5 * F.count(F.lit(1))).alias("weight"))
    edges = cooccurrence(df, id_col, item_col, item_col, distinct_ids=False).select("source", "target", "weight").filter(F.col("weight") >= least)
    return nodes, edges


def topic_graph(words: DataFrame, topic: str = "topic", word: str = "word", weight: str = "weight") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of topics' words: a node for each word with its topics' weights added and a size of a thousand times
    that, in its first topic's colour; all words of a topic are linked."""
    nodes = words.groupBy(F.col(word).alias("node")).agg(F.sum(weight).alias("weight"), (F.min(topic) % 18).cast("int").alias("colour"))
    edges = cooccurrence(words, topic, word, word, distinct_ids=False).select("source", "target")
    return nodes.withColumn("size", F.floor(F.col("weight") * 1000).cast("int")), edges.distinct()


def transitions(df: DataFrame, id_col: str, item_col: str, order: list[str]) -> DataFrame:
    """(source, target, weight, origins): each item with the next one of its record, by a window instead of arrays."""
    w = Window.partitionBy(id_col).orderBy(*order)
    rows = df.select(id_col, F.col(item_col).alias("source"), F.lead(item_col).over(w).alias("target")).filter("target is not null")
    return rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), F.countDistinct(id_col).alias("origins"))


def same_value(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """(id, class_id, others): records of equal value share the least id; ``others`` counts the rest of the class."""
    groups = df.groupBy(value_col).agg(F.min(id_col).alias("class_id"), (F.count(F.lit(1)) - 1).alias("others"))
    return df.join(groups, df[value_col].eqNullSafe(groups[value_col])).select(id_col, "class_id", "others")


def statistics(df: DataFrame, value: Column, names: list[str]) -> DataFrame:
    """Each record with its value's count (sample), the number of values (population), their quotient (frequency) and the
    description of all numbers. Whatever is no number counts as 0, as in the records it comes from."""
    rows = df.select(*names, value.cast("string").alias("_v"), F.coalesce(F.expr("try_cast(_x as double)"), F.lit(0.0)).alias("_n")) if "_x" in df.columns else df.select(*names, value.cast("string").alias("_v"), F.coalesce(value.try_cast("double"), F.lit(0.0)).alias("_n"))
    per = rows.groupBy("_v").agg(F.count(F.lit(1)).alias("sample"))
    whole = rows.agg(
        F.countDistinct("_v").alias("population"), F.count("_v").alias("count"), F.sum("_n").alias("sum"), F.min("_n").alias("min"), F.max("_n").alias("max"), F.avg("_n").alias("mean"),
        (F.max("_n") - F.min("_n")).alias("range"), ((F.max("_n") + F.min("_n")) / 2).alias("midrange"), F.var_pop("_n").alias("variance"), F.stddev_pop("_n").alias("deviation"),
    )
    out = rows.join(per, "_v").crossJoin(F.broadcast(whole))
    return out.withColumn("frequency", F.col("sample") / F.col("population")).withColumn("percentage", F.lit(None).cast("double")).drop("_v", "_n")


def frequent(df: DataFrame, item: str, least: int = 2) -> DataFrame:
    """(item, n): items that occur at least so often."""
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def spread_filter(df: DataFrame, item: str, group: str, most: float = 0.5) -> DataFrame:
    """Rows whose item is in at most a share of the groups."""
    total = df.agg(F.countDistinct(group).alias("_t"))
    per = df.groupBy(item).agg(F.countDistinct(group).alias("_g")).crossJoin(F.broadcast(total)).filter(F.col("_g") <= most * F.col("_t")).select(item)
    return df.join(per, item, "left_semi")


def tf_idf(df: DataFrame, doc: str, term: str) -> DataFrame:
    """(doc, term, tf, tfidf) with idf = ln((1 + N) / (1 + df)) + 1."""
    tf = df.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.countDistinct(doc).alias("_n"))
    per = tf.groupBy(term).agg(F.count(F.lit(1)).alias("_df")).crossJoin(F.broadcast(n))
    return tf.join(per, term).withColumn("tfidf", F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1)).drop("_n", "_df")


def majority(df: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """(group, value): the most frequent value, of equals the one seen first."""
    per = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_at"))
    return per.groupBy(group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_at"))).alias(value))


def top_k(df: DataFrame, group: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(name) <= k)


def cut_at_gap(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Rows of each group, best score first, up to its largest drop between neighbours."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).desc())
    rows = df.withColumn("_r", F.row_number().over(w)).withColumn("_gap", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    last = rows.groupBy(group).agg(F.max_by("_r", F.struct(F.round("_gap", 9), -F.col("_r"))).alias("_last"))
    return rows.join(last, group).filter("_r <= _last").drop("_gap", "_last").withColumnRenamed("_r", "rank")


def cumulative_share(df: DataFrame, item: str, count: str) -> DataFrame:
    """(item, count, share): the running share of all counts, most frequent first.

    The running sum is over the distinct counts, which are few, so the window stays small whatever the number of items.
    """
    levels = df.groupBy(count).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(F.col(count).desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    run = levels.withColumn("share", F.sum(F.col(count) * F.col("_n")).over(w) / F.sum(F.col(count) * F.col("_n")).over(total)).select(count, "share")
    return df.join(run, count)


def node_threshold(df: DataFrame, item: str, count: str, few: int = 100, words: int = 50) -> DataFrame:
    """(nodes, threshold): the least count of a node: 1 for few nodes; else the highest threshold with which at least
    ``words`` nodes stay, shares of 0.20, 0.225 ... 0.60 of all occurrences being tried in turn."""
    shares = cumulative_share(df, item, count)
    levels = shares.groupBy(count).agg(F.max("share").alias("share"), F.count(F.lit(1)).alias("_m"))
    kept = Window.orderBy(F.col(count).desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("nodes", F.sum("_m").over(kept))
    total = levels.agg(F.sum("_m").alias("all"))
    steps = df.sparkSession.range(17).select((F.lit(0.20) + F.col("id") * 0.025).alias("try"))
    tried = steps.join(levels, F.col("share") >= F.col("try") - 1e-9).groupBy("try").agg(F.min("nodes").alias("nodes"), F.max(count).alias("threshold"))
    enough = tried.filter((F.col("nodes") >= words) | (F.col("try") >= 0.6 - 1e-9)).agg(F.min_by(F.struct("nodes", "threshold"), "try").alias("s"))
    return enough.crossJoin(total).select(F.when(F.col("all") < few, F.col("all")).otherwise(F.col("s.nodes")).alias("nodes"), F.when(F.col("all") < few, F.lit(1).cast("bigint")).otherwise(F.col("s.threshold")).alias("threshold"))


def edge_threshold(node: Column) -> Column:
    """The least weight of an edge: 0 if every node stays, else a sixth of the nodes' threshold, 1 at least."""
    return F.when(node <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), node / 6))


def merge_nodes(df: DataFrame, key: str, attributes: list[str], targets: str, order: str) -> DataFrame:
    """Rows of one node made one: each attribute's first known value by ``order``, and all its targets, each once."""
    first = [F.min_by(F.when(F.col(a).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes]
    ends = df.select(key, F.explode(targets).alias("_t")).groupBy(key).agg(F.array_sort(F.collect_set("_t")).alias(targets))
    return df.groupBy(key).agg(*first).join(ends, key, "left")


def by_size(df: DataFrame, leader: str) -> DataFrame:
    """(leader, size, place): groups, the largest first, of equals the least leader."""
    sizes = df.groupBy(F.col(leader).alias("leader")).agg(F.count(F.lit(1)).alias("size"))
    placed = with_position(sizes.withColumn("_s", -F.col("size")), ["_s", "leader"], "place")
    return placed.select("leader", "size", (F.col("place") + 1).cast("int").alias("place"))


def citation_edges(refs: DataFrame, citing: str, cited: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): citing to cited with weights, and each node as citing, cited or both with its size."""
    edges = refs.filter(F.col(cited).isNotNull() & F.col(citing).isNotNull()).groupBy(F.col(citing).alias("source"), F.col(cited).alias("target")).agg(F.count(F.lit(1)).alias("weight"))
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("inn")).unionAll(edges.select(F.col("target").alias("node"), F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("inn").alias("count"), F.max("out").alias("o"), F.max("inn").alias("i"))
    status = F.when((F.col("o") == 1) & (F.col("i") == 1), "both").when(F.col("i") == 1, "cited").otherwise("citing")
    return edges, nodes.select("node", "count", status.alias("status"), (F.log10(F.col("count") + 1) * 50 + 50).alias("size"))
