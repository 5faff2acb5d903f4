"""Decision rules around models: what is asked of a model, and what is made of its answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.records import penalised
from corpusloom.functions.text import find_units, ratio, sentences, uniformize
from corpusloom.operators.learning import Predict, predict


def chosen_sentences(df: DataFrame, id_col: str, text_col: str, model: Predict, label: str = "1", shortest: int = 7, longest: int = 500) -> DataFrame:
    """(id, sentences): the sentences of 7 to 500 signs that a model gives a label, in text order; an empty array for none."""
    rows = df.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("_at", "_s")).filter(F.length("_s").between(shortest, longest))
    hits = predict(rows, "_s", model).filter(F.col("label") == label)
    per = hits.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]).alias("sentences"))
    return df.select(id_col).join(per, id_col, "left").withColumn("sentences", F.coalesce("sentences", F.array().cast("array<string>")))


def deep_cascade(df: DataFrame, text_col: str, models: dict[str, Predict], depth: int = 3, root: str = "") -> DataFrame:
    """Adds levels, an array of (rank, code, score): each level's model is the one named by the code above it; a code
    without a model, or the depth, ends the row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            out: list[list[dict]] = [[] for _ in texts]
            at = {root: list(range(len(texts)))}
            for rank in range(1, depth + 1):
                below: dict[str, list[int]] = {}
                for code, rows in at.items():
                    if code in models:
                        for k, (x, p) in zip(rows, models[code]([texts[k] for k in rows])):
                            out[k].append({"rank": rank, "code": x, "score": float(p)})
                            below.setdefault(x, []).append(k)
                at = below
            yield pd.Series(out)

    return df.withColumn("levels", F.pandas_udf(run, "array<struct<rank:int,code:string,score:double>>")(F.col(text_col)))


def research_document(kind: Column, item: Column, probability: Column, issue: Column, paratext: Column) -> Column:
    """(label, score): only articles and reviews of journals are judged; supplements, meetings and paratext are none; the
    score is that of the label given."""
    judged = (kind == "journal") & item.isin("article", "review")
    none = F.coalesce(F.lower(issue.cast("string")).rlike("sup|meet"), F.lit(False)) | F.coalesce(paratext, F.lit(False))
    p = F.when(none, 0.0).otherwise(probability)
    label = F.when(~F.coalesce(judged, F.lit(False)), "not_processed").when(p >= 0.5, "true").otherwise("false")
    return F.struct(label.alias("label"), F.when(label == "not_processed", 1.0).when(p >= 0.5, p).otherwise(1 - p).alias("score"))


def softmax_class(neighbours: DataFrame, labels: DataFrame, id_col: str, label_col: str, cut_off: float = 100.0) -> DataFrame:
    """(query, label, score): each class weighs the sum of 1 / distance of its neighbours, and the score is its softmax; rows
    whose nearest neighbour is ``cut_off`` away or more are dropped. Equal neighbours (class and distance) count once."""
    near = neighbours.groupBy("query").agg(F.min("distance").alias("_d")).filter(F.col("_d") < cut_off)
    rows = neighbours.join(near.select("query"), "query", "left_semi").join(labels.select(F.col(id_col).alias("neighbour"), F.col(label_col).alias("label")), "neighbour")
    votes = rows.select("query", "label", "distance").distinct().groupBy("query", "label").agg(F.sum(1 / F.greatest("distance", F.lit(1e-9))).alias("w"))
    all_ = Window.partitionBy("query")
    votes = votes.withColumn("score", F.exp(F.col("w") - F.max("w").over(all_))).withColumn("score", F.col("score") / F.sum("score").over(all_))
    return votes.groupBy("query").agg(F.min_by(F.struct("label", "score"), F.struct(-F.round("w", 9), F.col("label"))).alias("b")).select("query", "b.label", "b.score")


def structure_codes(df: DataFrame, id_col: str, text_col: str, units: DataFrame, model: Predict, seen: DataFrame, least: float = 0.71, default: str = "n/a") -> DataFrame:
    """(id, code): the code of the research unit that an affiliation names, else the one a model gives whose probability,
    held down for codes seldom seen in training, is at least ``least``. ``units``: unit, code; ``seen``: code, frequency."""
    rows = df.select(id_col, F.col(text_col).alias("_x"))
    named = rows.select(id_col, F.posexplode(find_units(F.col("_x"))).alias("_at", "unit")).join(units.select("unit", F.col("code").alias("_c")), "unit")
    named = named.groupBy(id_col).agg(F.min_by("_c", "_at").alias("_unit"))
    asked = predict(rows.join(named, id_col, "left_anti"), "_x", model).join(seen.select(F.col("code").alias("label"), "frequency"), "label", "left")
    sure = asked.filter(penalised(F.col("score"), F.coalesce("frequency", F.lit(0))) >= least).select(id_col, F.col("label").alias("_model"))
    return rows.join(named, id_col, "left").join(sure, id_col, "left").select(id_col, F.coalesce("_unit", "_model", F.lit(default)).alias("code"))


def affiliation_parts(c: Column, shortest: int = 3) -> Column:
    """The affiliations of a field with semicolons between them; those under three signs are left out."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: F.length(x) >= shortest)


def country_of_unit(c: Column, code: str = "fr") -> Column:
    """The country that a unit's code gives away, or null."""
    return F.when(F.size(find_units(c)) > 0, code)


def fenced_block(c: Column, shortest: int = 10) -> Column:
    """What stands between the first fences of three backticks, on one line; empty if there is none or it is too short."""
    inner = F.trim(F.replace(F.replace(F.get(F.split(c, "```"), F.lit(1)), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")))
    return F.when(F.length(inner) >= shortest, inner).otherwise("")


def asked_until_answered(model: Callable[[str], str], prompt: str, tries: int = 3, shortest: int = 10) -> str:
    """Asks a generator for a fenced block until it gives one; empty for requests or answers under ten signs."""
    if not prompt or len(prompt) < shortest:
        return ""
    for _ in range(tries):
        parts = model(prompt).split("```")
        if len(parts) > 1 and len(block := " ".join(parts[1].split())) >= shortest:
            return block
    return ""


def summary_text(text: Column, summary: Column, words: int = 30, mark: str = " <AI-generated>") -> Column:
    """A summary with its mark; a text of few words stays as it is, and no text gives an empty one."""
    n = F.size(F.split(F.trim(text), "\\s+"))
    return F.when(text.isNull(), "").when(n < words, text).otherwise(F.concat(summary, F.lit(mark)))


def aligned_places(names: DataFrame, places: DataFrame, id_col: str, name_col: str, key: str, place_col: str, least: float = 0.8, choose: Column | None = None) -> DataFrame:
    """(id, place, score): candidates share the first three letters of their uniform names and are alike; the choice is one
    of them or -1. Each distinct name is compared once."""
    own = names.select(id_col, uniformize(F.col(name_col)).alias("_n"))
    asked = own.filter("length(_n) >= 3").select("_n").distinct().withColumn("_b", F.substring("_n", 1, 3))
    listed = places.select(F.col(key).alias("place"), uniformize(F.col(place_col)).alias("_p"), *([choose.alias("_w")] if choose is not None else [F.lit(0).alias("_w")]))
    shapes = listed.select("_p").distinct().withColumn("_b", F.substring("_p", 1, 3))
    # two names whose lengths are too far apart cannot reach the ratio
    fits = 2 * F.least(F.length("_n"), F.length("_p")) >= least * (F.length("_n") + F.length("_p"))
    alike = asked.join(shapes, "_b").filter(fits).withColumn("score", ratio(F.col("_n"), F.col("_p"))).filter(F.col("score") >= least)
    best = alike.join(listed, "_p").groupBy("_n").agg(F.min_by(F.struct("place", "score"), F.struct(-F.round("score", 9), -F.col("_w"), F.col("place"))).alias("b"))
    return own.join(best, "_n", "left").select(id_col, F.coalesce("b.place", F.lit(-1)).alias("place"), F.col("b.score").alias("score"))


def hidden_text(x: Column, y: Column, size: Column, colour: Column, width: Column, height: Column, smallest: float = 2.0, white: str = "#ffffff") -> Column:
    """Why a piece of text on a page cannot be seen: ``off page``, ``tiny``, ``white`` or null."""
    return F.when((x < 0) | (y < 0) | (x > width) | (y > height), "off page").when(size < smallest, "tiny").when(F.lower(colour) == white, "white")


def noise_label(text: Column, noise: Column) -> Column:
    """``no_abstract``, ``noise`` or ``relevant``."""
    return F.when(text.isNull() | (F.trim(text) == ""), "no_abstract").when(noise, "noise").otherwise("relevant")


def boolean_score(score: Column, digits: int = 3) -> Column:
    """(label, score): whether a score is a half or more, and the score as text with three digits."""
    return F.struct((score >= 0.5).alias("label"), F.format_string(f"%.{digits}f", score.cast("double")).alias("score"))
