"""Terms: extraction from texts, dictionary annotation, species names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import spread

#: Function words of English and French, which end a term.
STOP_WORDS = {
    "en": "a about after all also although an and any are as at be because been between both but by can could did do does during each for from had has have he her his how however if in into is it its more most no nor not of on one only or other our over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split(),
    "fr": "à afin ainsi alors au aucun aussi autre aux avec avoir car ce cela ces cet cette ceux chez comme contre dans de depuis des donc dont du elle en entre est et été être eux il ils je la le les leur leurs lors lui mais malgré même moins ne ni nos notre nous on ou où par pas pendant plus pour puis puisque quand que quel qui sa sans se selon ses si son sont sous sur ta tes ton tous tout toute très tu un une vers vos votre vous".split(),
}
#: Endings by which a word is taken for a verb, participle or adverb rather than part of a noun phrase.
NOT_NOMINAL = {"en": "ly|ises|izes|ifies|ing|ed", "fr": "aient|ait|er|ir|ées?|és?"}
#: Possessive endings and elided words, which end a term.
CLITICS = {"en": "(?<=\\p{L})['’]s(?![\\p{L}\\p{N}])", "fr": "(?<![\\p{L}\\p{N}])(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu)['’]"}


def term_runs(c: Column, lang: str = "en", numbers: bool = False) -> Column:
    """The runs of words of a text that may make a term, in lower case: array of strings.

    Function words, verbs and adverbs by their ending, words of one or two letters, those with figures (unless
    ``numbers``) and every sign but hyphen and apostrophe part the runs, hence sentences do so as well.
    """
    edge = "[\\p{L}\\p{N}'’-]"
    short = "\\p{L}" if numbers else "\\p{L}{1,2}"
    bad = ["|".join(STOP_WORDS[lang]), f"\\p{{L}}{edge}*(?:{NOT_NOMINAL[lang]})", short, "['’-]+"] + ([] if numbers else [f"{edge}*\\p{{N}}{edge}*"])
    text = F.regexp_replace(F.regexp_replace(F.lower(c), CLITICS[lang], " | "), "[^\\p{L}\\p{N}\\s'’-]+|\\n\\s*\\n", " | ")
    marked = F.regexp_replace(text, f"(?<!{edge})(?:{'|'.join(bad)})(?!{edge})", "|")
    return F.filter(F.transform(F.split(marked, "\\|"), lambda r: F.trim(F.regexp_replace(r, "\\s+", " "))), lambda r: r != "")


def term_candidates(df: DataFrame, id_col: str, text_col: str, lang: str = "en", most_words: int = 4, numbers: bool = False) -> DataFrame:
    """(id, term): one row for each occurrence of a term: every run, of a run of more than ``most_words`` words all pieces
    of that many, and every word of a run of several; terms of less than 3 or more than 50 signs are none."""
    runs = spread(df.select(id_col, text_col)).select(id_col, F.explode(term_runs(F.col(text_col), lang, numbers)).alias("_r")).select(id_col, "_r", F.split("_r", " ").alias("_w"))
    n = F.size("_w")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - most_words + 1)), lambda i: F.array_join(F.slice("_w", i, most_words), " "))
    terms = F.when(n == 1, F.col("_w")).otherwise(F.concat(F.when(n > most_words, pieces).otherwise(F.array("_r")), "_w"))
    return runs.select(id_col, F.explode(terms).alias("term")).filter("length(term) between 3 and 50" + ("" if numbers else " and term rlike '\\\\p{L}'"))


def specific_terms(df: DataFrame, id_col: str, text_col: str, lang: str = "en", top: int | None = None, reference: DataFrame | None = None, numbers: bool = False) -> DataFrame:
    """(id, term, frequency, specificity): terms of each text, the most specific first.

    Specificity is the frequency over the term's weight in a reference (1 where it has none), as a share of the
    highest of the text. Single words that occur once only go, unless that leaves a text without any.
    """
    freq = term_candidates(df, id_col, text_col, lang, numbers=numbers).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("frequency"))
    if reference is not None:
        freq = freq.join(reference.select("term", F.col("weight").alias("_wt")), "term", "left").withColumn("_wt", F.coalesce("_wt", F.lit(1.0)))
    else:
        freq = freq.withColumn("_wt", F.lit(1.0))
    w = Window.partitionBy(id_col)
    score = freq.withColumn("_sp", F.col("frequency") / F.col("_wt"))
    score = score.withColumn("specificity", F.round(F.col("_sp") / F.max("_sp").over(w), 4))
    often = (F.col("frequency") > 1) | F.col("term").contains(" ")
    score = score.withColumn("_keep", often).withColumn("_any", F.max(often.cast("int")).over(w)).filter("_keep or _any = 0")
    order = Window.partitionBy(id_col).orderBy(F.col("_sp").desc(), F.col("frequency").desc(), "term")
    out = score.withColumn("rank", F.row_number().over(order))
    out = out.filter(F.col("rank") <= top) if top else out
    return out.select(id_col, "term", "frequency", "specificity", "rank")


def corpus_terms(df: DataFrame, id_col: str, text_col: str, lang: str = "en", top: int = 500) -> DataFrame:
    """(key, freq, spec): terms of the whole corpus, the most specific ones: frequency by the share of texts without it."""
    rows = term_candidates(df, id_col, text_col, lang)
    per = rows.groupBy("term").agg(F.count(F.lit(1)).alias("freq"), F.countDistinct(id_col).alias("_df"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = per.filter("freq > 1").crossJoin(F.broadcast(n)).withColumn("spec", F.round(F.col("freq") * F.log(F.col("_n") / F.col("_df")), 6))
    return out.orderBy(F.col("spec").desc(), "term").limit(top).select(F.col("term").alias("key"), "freq", "spec")


def minimal_terms(terms: DataFrame) -> DataFrame:
    """(id, value): terms of a corpus with their frequencies, and nothing else."""
    return terms.select(F.col("key").alias("id"), F.col("freq").alias("value"))


#: Fixed value: a binomial: a capital genus (or its initial) and a species in small letters.
BINOMIAL = "(\\p{Lu}\\p{Ll}+|\\p{Lu}\\.) (\\p{Ll}[\\p{Ll}-]{2,})"


def species_names(df: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name): binomials of a reference list in texts, distinct; ``G. species`` counts for a genus of the list that
    the same text names in full."""
    found = df.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(BINOMIAL), F.lit(0))).alias("found")).distinct()
    known = names.select(F.col(names.columns[0]).alias("name")).distinct()
    full = found.join(known, found["found"] == known["name"]).select(id_col, "name")
    genera = full.select(id_col, F.substring_index("name", " ", 1).alias("genus")).distinct()
    short = found.filter(F.col("found").rlike("^\\p{Lu}\\. ")).select(id_col, F.substring("found", 1, 1).alias("_i"), F.substring_index("found", " ", -1).alias("_sp"))
    spelt = short.join(genera.withColumn("_i", F.substring("genus", 1, 1)), [id_col, "_i"]).select(id_col, F.concat_ws(" ", "genus", "_sp").alias("name"))
    return full.unionByName(spelt.join(known, "name", "left_semi").select(id_col, "name")).distinct()


def dictionary_tools(tools: list[str], text_col: str) -> Column:
    """Names of a bounded list in a text, longest first, whole words, any case, each once in the order seen."""
    import re

    pattern = "(?iU)(?<![\\p{L}\\p{N}])(" + "|".join(re.escape(t) for t in sorted(tools, key=len, reverse=True)) + ")(?![\\p{L}\\p{N}])"
    return F.array_distinct(F.transform(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)), lambda x: F.lower(x)))


def labelled_spans(df: DataFrame, tokens: str, tags: str, scores: str | None = None, least: float = 0.0) -> Column:
    """Spans of equal neighbouring tags from parallel arrays of tokens and tags (``O`` for none): array of (text, tag, score).

    ``B-`` and ``I-`` are dropped from tags, a ``B-`` beginning a new span; spans under the mean score go, as do those of
    one sign or without a letter or figure.
    """
    n = F.size(tokens)
    one = lambda i: F.struct(F.get(F.col(tokens), i).alias("w"), F.regexp_replace(F.get(F.col(tags), i), "^[BI]-", "").alias("t"), F.get(F.col(tags), i).startswith("B-").alias("b"), (F.get(F.col(scores), i) if scores else F.lit(1.0)).cast("double").alias("s"))
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))
    empty = F.array().cast("array<struct<text:string,tag:string,sum:double,n:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(F.concat_ws(" ", last["text"], x["w"]).alias("text"), x["t"].alias("tag"), (last["sum"] + x["s"]).alias("sum"), (last["n"] + 1).alias("n"))
        new = F.struct(x["w"].alias("text"), x["t"].alias("tag"), x["s"].alias("sum"), F.lit(1).alias("n"))
        joins = (F.size(acc) > 0) & last["tag"].eqNullSafe(x["t"]) & ~x["b"]
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    spans = F.aggregate(rows, empty, step)
    good = F.filter(spans, lambda s: (s["tag"] != "O") & (s["sum"] / s["n"] >= least) & (F.length(s["text"]) > 1) & s["text"].rlike("[\\p{L}\\p{N}]"))
    return F.transform(good, lambda s: F.struct(s["text"].alias("text"), s["tag"].alias("tag"), (s["sum"] / s["n"]).alias("score")))


def match_score(count: Column, total: Column, notices: Column) -> Column:
    """How sure a term of a document stands for a notice: its share of the document's matches and how few notices share it."""
    return 0.7 * F.pow(count / total, F.lit(0.25)) + 0.3 * F.pow(1 / notices, F.lit(0.5))


def score_matches(matches: DataFrame, id_col: str, term: str = "term") -> DataFrame:
    """(id, term, count, score): terms found in documents, a term that several notices have counting less."""
    counts = matches.groupBy(id_col, term).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(id_col))
    docs = matches.groupBy(term).agg(F.countDistinct(id_col).alias("_docs"))
    rows = counts.withColumn("_total", total).join(docs, term)
    return rows.select(id_col, term, "count", match_score(F.col("count"), F.col("_total"), F.col("_docs")).alias("score"))
