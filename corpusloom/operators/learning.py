"""Learned operators: topics, clusters, neighbours, communities, and shells for outside models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import deburr
from corpusloom.operators.analytics import spread_filter, tf_idf
from corpusloom.session import cut, spread

#: Words of a vocabulary, which the driver holds; those in too few or too many texts are left out before.
MOST_TERMS = 1 << 22
#: Words that one part of a table has at least where several parts are trained side by side.
PART_WORDS = 250_000
Predict = Callable[[list[str]], list[tuple[str, float]]]


def predict(df: DataFrame, text_col: str, model: Predict, default: str = "n/a", least: float = 0.0, shortest: int = 0) -> DataFrame:
    """label and score of each text by a model over batches; short texts, and scores below ``least``, get the default."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            ok = s.notna() & (s.fillna("").str.len() >= max(1, shortest))
            got = iter(model(s[ok].tolist()))
            rows = [next(got) if k else (None, None) for k in ok]
            yield pd.DataFrame({"label": [r[0] for r in rows], "score": [r[1] for r in rows]})

    out = df.withColumn("_p", F.pandas_udf(run, "label string, score double")(F.col(text_col)))
    sure = F.coalesce(F.col("_p.score") >= least, F.lit(False))
    return out.withColumn("label", F.when(sure, F.col("_p.label")).otherwise(default)).withColumn("score", F.col("_p.score")).drop("_p")


def cascade(df: DataFrame, text_col: str, first: Predict, second: dict[str, Predict], least: float = 0.5) -> DataFrame:
    """Two classifiers in a row: the first one's label chooses the second; unsure ones stop early."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = s.fillna("").tolist()
            top = first(texts)
            out = [("", "", 0.0)] * len(texts)
            for label in {x for x, p in top if p >= least}:
                at = [k for k, (x, p) in enumerate(top) if x == label and p >= least]
                low = second[label]([texts[k] for k in at]) if label in second else [("", top[k][1]) for k in at]
                for k, (x, p) in zip(at, low):
                    out[k] = (label, x, p)
            yield pd.DataFrame(out, columns=["domain", "field", "score"])

    return df.withColumn("_p", F.pandas_udf(run, "domain string, field string, score double")(F.col(text_col))).select("*", "_p.*").drop("_p")


def topic_words(c: Column, most: int | None = 1000) -> Column:
    """Words of a text for topics: without accents, longer than three letters, the first ``most`` or all."""
    words = F.split(F.trim(F.regexp_replace(F.lower(deburr(c)), "[^a-z]+", " ")), " ")
    words = F.filter(words, lambda w: F.length(w) > 3)
    return words if most is None else F.slice(words, 1, most)


def topics(df: DataFrame, id_col: str, text_col: str, k: int = 5, words: int = 10, seed: int = 42, iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """(documents, topics): (id, topics map, best_topic), 'n/a' for a text without words; and (topic, word, weight).

    Words are in 2 texts (5 of over 1000) at least and in half of them at most; a topic of a text has a weight of .2,
    .15 or .1 at least as there are under 6, under 11 or more topics. k is kept between 2 and 18.
    """
    k = min(18, max(2, k))
    least = 0.2 if k < 6 else 0.15 if k < 11 else 0.1
    rows = cut(spread(df.select(id_col, text_col)).select(id_col, topic_words(F.col(text_col)).alias("words")))
    full = rows.filter("size(words) > 0")
    n = full.count()
    vec = CountVectorizer(inputCol="words", outputCol="counts", minDF=5.0 if n > 1000 else 2.0, maxDF=0.5, vocabSize=MOST_TERMS).fit(full)
    data = cut(vec.transform(full).select(id_col, "counts"))
    held = data.select("counts").persist()  # every iteration reads a sample of all
    model = LDA(featuresCol="counts", k=k, seed=seed, maxIter=iterations, optimizer="online").fit(held)
    held.unpersist()
    dist = model.transform(data).select(id_col, vector_to_array("topicDistribution").alias("d"))
    best = (F.expr("array_position(d, array_max(d))") - 1).cast("int")
    kept = F.expr(f"map_from_entries(filter(transform(d, (x, i) -> struct(concat('topic_', i) as k, round(x, 6) as v)), e -> e.v >= {least}))")
    docs = rows.select(id_col).join(dist.select(id_col, kept.alias("topics"), F.concat(F.lit("topic_"), best).alias("best_topic")), id_col, "left").withColumn("best_topic", F.coalesce("best_topic", F.lit("n/a")))
    vocabulary = F.array(*[F.lit(v) for v in vec.vocabulary]) if len(vec.vocabulary) < 2000 else None
    top = model.describeTopics(words)
    pairs = top.select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("p")).select("topic", "p.*")
    if vocabulary is None:
        names = df.sparkSession.createDataFrame(list(enumerate(vec.vocabulary)), "termIndices int, word string")
        return docs, pairs.join(names, "termIndices").select("topic", "word", F.col("termWeights").alias("weight"))
    return docs, pairs.select("topic", F.get(vocabulary, F.col("termIndices")).alias("word"), F.col("termWeights").alias("weight"))


def choose_topics(df: DataFrame, text_col: str, low: int = 2, high: int = 18, step: int = 4, iterations: int = 5, seed: int = 42) -> int:
    """The number of topics with the lowest perplexity bound: every ``step`` first, then the neighbours of the best."""
    rows = df.select(topic_words(F.col(text_col)).alias("words")).filter("size(words) > 0")
    data = CountVectorizer(inputCol="words", outputCol="counts", minDF=2.0, maxDF=0.5, vocabSize=MOST_TERMS).fit(rows).transform(rows).select("counts").persist()
    known: dict[int, float] = {}

    def bound(k: int) -> float:
        if k not in known:
            known[k] = LDA(featuresCol="counts", k=k, seed=seed, maxIter=iterations, optimizer="online").fit(data).logPerplexity(data)
        return known[k]

    best = min(range(low, high + 1, step), key=bound)
    best = min(range(max(low, best - 2), min(high, best + 2) + 1), key=bound)
    data.unpersist()
    return best


def choose_clusters(df: DataFrame, vec_col: str, low: int = 2, high: int = 21, seed: int = 42) -> int:
    """The number of clusters with the best silhouette, by ternary search between low and high."""
    data = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features")).persist()
    known: dict[int, float] = {}

    def score(k: int) -> float:
        if k not in known:
            model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
            known[k] = ClusteringEvaluator().evaluate(model.transform(data))
        return known[k]

    while high - low > 2:
        a, b = low + (high - low) // 3, high - (high - low) // 3
        low, high = (low, b - 1) if score(a) >= score(b) else (a + 1, high)
    best = max(range(low, high + 1), key=score)
    data.unpersist()
    return best


def davies_bouldin(assigned: DataFrame, centres: np.ndarray) -> float:
    """How much clusters overlap: the mean over clusters of the worst (spread + spread) / distance of centres. ``assigned``:
    cluster from 1, distance."""
    spread = np.zeros(len(centres))
    for r in assigned.groupBy("cluster").agg(F.avg("distance").alias("s")).collect():
        spread[r["cluster"] - 1] = r["s"]
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    np.fill_diagonal(apart, np.inf)
    return float(((spread[:, None] + spread[None]) / np.maximum(apart, 1e-12)).max(1).mean())


def choose_summary_clusters(df: DataFrame, id_col: str, vec_col: str, low: int = 2, high: int = 8, seed: int = 42) -> int:
    """The number of clusters to sum a corpus up by: half the silhouette less half the overlap is highest."""
    data = cut(df.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features")))
    best = (-np.inf, -low)
    for k in range(low, high + 1):
        model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
        done = model.transform(data)
        centres = np.array(model.clusterCenters())
        far = _distances(centres)
        assigned = done.select((F.col("prediction") + 1).alias("cluster"), far(vector_to_array("features"), "prediction").alias("distance"))
        best = max(best, (0.5 * ClusteringEvaluator().evaluate(done) - 0.5 * davies_bouldin(assigned, centres), -k))
    return -best[1]


def _distances(centres: np.ndarray):
    return F.pandas_udf(lambda v, c: pd.Series(np.linalg.norm(np.stack(v.to_numpy()) - centres[c.to_numpy()], axis=1)) if len(v) else pd.Series([], dtype="float64"), "double")


def cluster_keywords(texts: DataFrame, assigned: DataFrame, id_col: str, words_col: str, top: int = 10, most: float = 0.5) -> DataFrame:
    """(cluster, term, rank): the words with the highest tf-idf of each cluster, but those that over half of the clusters have."""
    rows = texts.select(id_col, F.explode(words_col).alias("term")).join(assigned.select(id_col, "cluster"), id_col)
    kept = spread_filter(rows, "term", "cluster", most)
    order = Window.partitionBy("cluster").orderBy(F.round("tfidf", 9).desc(), "term")
    return tf_idf(kept, "cluster", "term").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("cluster", "term", "rank")


def clusters(df: DataFrame, id_col: str, vec_col: str, k: int, seed: int = 42) -> DataFrame:
    """(id, cluster, distance): cluster from 1, and the distance from its centre."""
    data = df.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
    centres = np.array(model.clusterCenters())
    far = _distances(centres)
    out = model.transform(data).withColumn("features", vector_to_array("features"))
    return out.select(id_col, (F.col("prediction") + 1).alias("cluster"), far("features", "prediction").alias("distance"))


def representatives(assigned: DataFrame, id_col: str, per_run: int = 16, farthest: bool = True) -> DataFrame:
    """Per cluster the ids to sum it up by: 16 // k of them, farthest from the centre first."""
    k = assigned.agg(F.countDistinct("cluster").alias("k"))
    order = F.col("distance").desc() if farthest else F.col("distance").asc()
    rows = assigned.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(order, id_col)))
    return rows.crossJoin(F.broadcast(k)).filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.lit(per_run) / F.col("k")))).drop("k")


def sparse_points(neighbours: DataFrame, k: int, factor: float = 2.0) -> DataFrame:
    """(query, core, noise): the distance of the k-th neighbour, and whether it is ``factor`` times the median or more."""
    core = neighbours.groupBy("query").agg(F.max("distance").alias("core"))
    middle = core.agg(F.percentile_approx("core", 0.5, 100_000).alias("_m"))
    return core.crossJoin(F.broadcast(middle)).select("query", "core", (F.col("core") >= factor * F.col("_m")).alias("noise"))


def keyword_vectors(df: DataFrame, id_col: str, words_col: str, size: int = 300, window: int = 5, least: int = 5, iterations: int = 10, seed: int = 1):
    """A skip-gram model of keywords, and the highest tf-idf of each: (model, (term, tfidf)).

    From two times ``PART_WORDS`` words on the parts of the table are trained side by side, as many as there are cores at
    most, and their vectors averaged after each iteration."""
    n = df.agg(F.sum(F.size(words_col))).first()[0] or 0
    parts = int(max(1, min(df.sparkSession.sparkContext.defaultParallelism, n // PART_WORDS)))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=iterations, seed=seed, numPartitions=parts, inputCol=words_col, outputCol="_v").fit(df)
    # a term's idf is the same in all texts, so its highest tf-idf is that of its highest tf
    tf = df.select(id_col, F.explode(words_col).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    texts = df.filter(F.size(words_col) > 0).agg(F.countDistinct(id_col).alias("_n"))
    per = tf.groupBy("term").agg(F.max("tf").alias("tf"), F.count(id_col).alias("_df")).crossJoin(F.broadcast(texts))
    return model, per.select("term", (F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1)).alias("tfidf"))


def keyword_neighbours(model, weight: DataFrame, word: str, most: int = 1000, low: float = 0.05, least: float = 0.5) -> DataFrame:
    """(term, score): of the ``most`` words nearest to one, those whose similarity is at least ``low`` and whose score, four
    fifths similarity and one fifth the share of the highest tf-idf, is at least ``least``."""
    near = model.findSynonyms(word, most).filter(F.col("similarity") >= low)
    rows = near.join(weight.withColumnRenamed("term", "word"), "word")
    top = Window.partitionBy()
    return rows.withColumn("score", 0.8 * F.col("similarity") + 0.2 * F.col("tfidf") / F.max("tfidf").over(top)).filter(F.col("score") >= least).select(F.col("word").alias("term"), "score")


def communities(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, community) by label propagation over weighted edges (source, target, weight), least label among equals.

    Each round every node takes the label with the most weight among its neighbours, its own label having a vote as well.
    By turns only half of the nodes, set by a hash that changes, may change theirs, so that pairs do not swap for ever.
    Stops when neither half changes any more; labels that do not settle are an error.
    """
    both = cut(edges.select("source", "target", "weight").unionAll(edges.select("target", "source", "weight")).toDF("a", "b", "w").filter("a != b"))
    labels = cut(both.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("community")))
    own = both.groupBy("a").agg(F.max("w").alias("w")).select("a", F.col("a").alias("b"), (F.col("w") * 0.5).alias("w"))
    votes_from = cut(both.unionAll(own))
    quiet = 0
    for k in range(most_rounds):
        votes = votes_from.join(labels.select(F.col("node").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.min_by("community", F.struct(-F.round("w", 9), F.col("community"))).alias("_best"))
        turn = F.pmod(F.xxhash64("node", F.lit(k // 2)), F.lit(2)) == k % 2
        now = cut(labels.join(best.withColumnRenamed("a", "node"), "node").select("node", F.when(turn, F.col("_best")).otherwise(F.col("community")).alias("new"), (turn & (F.col("_best") != F.col("community"))).alias("moved")))
        quiet = 0 if now.filter("moved").limit(1).count() else quiet + 1
        labels = now.select("node", F.col("new").alias("community"))
        if quiet == 3:  # both halves of one division are among these rounds
            return labels
    raise RuntimeError("the communities did not settle")


def extract_summary(df: DataFrame, id_col: str, text_col: str, keep: int = 3, shortest: int = 30) -> DataFrame:
    """(id, summary): the sentences with the highest mean tf-idf, in text order; texts under ``shortest`` words stay whole."""
    from corpusloom.functions.text import sentences

    sents = spread(df.select(id_col, text_col)).select(id_col, F.posexplode(sentences(F.col(text_col))).alias("_at", "_s"))
    words = sents.select(id_col, "_at", F.explode(F.split(F.trim(F.regexp_replace(F.lower("_s"), "[^\\p{L}]+", " ")), " ")).alias("w")).filter("length(w) > 3")
    weight = tf_idf(words.select(id_col, "w"), id_col, "w").select(id_col, "w", "tfidf")
    score = words.join(weight, [id_col, "w"]).groupBy(id_col, "_at").agg(F.avg("tfidf").alias("_x"))
    ranked = sents.join(score, [id_col, "_at"], "left").withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.round("_x", 9).desc_nulls_last(), "_at"))).filter(F.col("_r") <= keep)
    short = ranked.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", "_s"))).alias("_v")).select(id_col, F.array_join(F.transform("_v", lambda v: v["_s"]), " ").alias("_sum"))
    n = F.size(F.split(F.trim(F.col(text_col)), "\\s+"))
    return df.join(short, id_col, "left").select(id_col, F.when(n < shortest, F.col(text_col)).otherwise(F.col("_sum")).alias("summary"))


def idf_weights(df: DataFrame, words_col: str, vocabulary: int = MOST_TERMS):
    """Fitted count and idf models for a column of words."""
    counts = CountVectorizer(inputCol=words_col, outputCol="_c", vocabSize=vocabulary).fit(df)
    return counts, IDF(inputCol="_c", outputCol="_tfidf").fit(counts.transform(df))
