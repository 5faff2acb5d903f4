"""Entities from tagged tokens: what happens between a tagger's labels and the lists it gives.

Tokens are rows (id, pos, token, tag and score); islands of tags are found by windows over one text, so a text of any
length is no single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import uniformize


def tagged_tokens(df: DataFrame, id_col: str, tokens: str, tags: str, scores: str | None = None) -> DataFrame:
    """(id, pos, token, tag, score): the rows of parallel arrays."""
    parts = [F.col(tokens).alias("token"), F.col(tags).alias("tag"), *([F.col(scores).alias("score")] if scores else [])]
    rows = df.select(id_col, F.posexplode(F.arrays_zip(*parts)).alias("pos", "t"))
    return rows.select(id_col, "pos", F.col("t.token").alias("token"), F.col("t.tag").alias("tag"), (F.col("t.score") if scores else F.lit(1.0)).cast("double").alias("score"))


def spans(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, start, text, tag, score): neighbouring tokens of one tag made one, ``O`` left out. ``B-`` begins a new one."""
    w = Window.partitionBy(id_col).orderBy("pos")
    bare = F.regexp_replace("tag", "^[BI]-", "")
    marked = rows.withColumn("_t", bare).withColumn("_new", (F.col("tag").startswith("B-") | ~F.col("_t").eqNullSafe(F.lag(bare).over(w))).cast("int"))
    return _gather(marked.withColumn("_island", F.sum("_new").over(w)), id_col)


def _gather(islands: DataFrame, id_col: str) -> DataFrame:
    """Each island's tokens in order, spaces between them."""
    words = F.array_sort(F.collect_list(F.struct("pos", "token")))
    per = islands.filter("_t != 'O'").groupBy(id_col, "_island", F.col("_t").alias("tag")).agg(F.min("pos").alias("start"), words.alias("_w"), F.avg("score").alias("score"))
    return per.select(id_col, "start", F.array_join(F.transform("_w", lambda x: x["token"]), " ").alias("text"), "tag", "score")


def sure_spans(found: DataFrame, least: float = 0.7, shortest: int = 2, longest: int = 99) -> DataFrame:
    """Entities with a mean score above ``least``, of 2 to 99 signs and with a letter or figure."""
    return found.filter((F.col("score") > least) & F.length(F.trim("text")).between(shortest, longest) & F.col("text").rlike("[\\p{L}\\p{N}]"))


def person_spans(rows: DataFrame, id_col: str, least: float = 0.7) -> DataFrame:
    """Entities of a tagger without begin marks. Where one tag follows another directly, the first entity is kept whatever
    its length, and the first token of the second one is lost; what follows it begins a new one."""
    w = Window.partitionBy(id_col).orderBy("pos")
    runs = rows.withColumn("_t", F.col("tag")).withColumn("_new", (~F.col("tag").eqNullSafe(F.lag("tag").over(w))).cast("int")).withColumn("_island", F.sum("_new").over(w))
    sizes = runs.groupBy(id_col, "_island").agg(F.first("tag").alias("_t"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(id_col).orderBy("_island")
    # a stretch is a row of runs without O between them; within it, runs of one token close and open by turns
    sizes = sizes.withColumn("_stretch", F.sum((F.col("_t") == "O").cast("int")).over(order))
    inside = Window.partitionBy(id_col, "_stretch").orderBy("_island")
    sizes = sizes.filter("_t != 'O'").withColumn("_long", F.sum((F.col("_n") > 1).cast("int")).over(inside))
    since = Window.partitionBy(id_col, "_stretch", "_long").orderBy("_island")
    # a run leaves an entity open unless its only token is lost: of single ones, counted with a longer one before, every second
    sizes = sizes.withColumn("_open", (F.col("_n") > 1) | (F.row_number().over(since) % 2 == 1))
    sizes = sizes.withColumn("_lost", F.coalesce(F.lag("_open").over(inside), F.lit(False))).withColumn("_cut", F.lead("_island").over(inside).isNotNull())
    first = Window.partitionBy(id_col, "_island").orderBy("pos")
    kept = runs.join(sizes.select(id_col, "_island", "_lost", "_cut"), [id_col, "_island"]).withColumn("_at", F.row_number().over(first)).filter("not _lost or _at > 1")
    out = _gather(kept, id_col).join(kept.groupBy(id_col, "_island").agg(F.min("pos").alias("start"), F.first("_cut").alias("_cut")).drop("_island"), [id_col, "start"])
    good = F.length(F.trim("text")).between(2, 99) & F.col("text").rlike("[\\p{L}\\p{N}]")
    return out.filter((F.col("score") > least) & (F.col("_cut") | good)).drop("_cut")


def repaired_spans(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, start, text, tag, score) from word pieces: a piece that begins with ``##`` never begins an entity, and belongs
    to the one before it; an inner tag behind none begins one. Pieces are glued to what they continue."""
    w = Window.partitionBy(id_col).orderBy("pos")
    piece, raw = F.col("token").startswith("##"), F.col("tag") != "O"
    rows = rows.withColumn("_piece", piece).withColumn("_word", F.sum((~piece).cast("int")).over(w))
    within = Window.partitionBy(id_col, "_word").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.max(raw.cast("int")).over(within) == 1)
    begins = F.col("_in") & (~F.coalesce(F.lag("_in").over(w), F.lit(False)) | (F.col("tag").startswith("B-") & ~F.col("_piece")))
    rows = rows.withColumn("_island", F.sum(begins.cast("int")).over(w)).filter("_in").withColumn("_t", F.regexp_replace("tag", "^[BI]-", ""))
    words = F.array_sort(F.collect_list(F.struct("pos", "token")))
    kind = F.min_by("_t", F.when(F.col("_t") != "O", F.col("pos")))
    per = rows.groupBy(id_col, "_island").agg(F.min("pos").alias("start"), words.alias("_w"), kind.alias("tag"), F.avg("score").alias("score"))
    text = F.replace(F.array_join(F.transform("_w", lambda x: x["token"]), " "), F.lit(" ##"), F.lit(""))
    return per.select(id_col, "start", text.alias("text"), "tag", "score")


def curated(c: Column) -> Column:
    """An entity without the spaces that tokenising put beside hyphens and brackets; null if a piece mark is left."""
    out = c
    for sign, before in (("-", True), ("(", True), (")", True), ("[", True), ("]", True)):
        out = F.replace(F.replace(out, F.lit(f"{sign} "), F.lit(sign)), F.lit(f" {sign}"), F.lit(sign))
    return F.when(~c.contains("#"), out)


def first_of_kind(found: DataFrame, id_col: str, text: str = "text", order: str = "start") -> DataFrame:
    """The first of those entities of a text that are the same but for case, accents and punctuation."""
    w = Window.partitionBy(id_col, uniformize(F.col(text))).orderBy(order)
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def named_lists(found: DataFrame, id_col: str, names: dict[str, str]) -> DataFrame:
    """(id, lists): a map of a tag's name to its distinct entities in the order in which they were found; no empty lists."""
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    per = found.filter(F.col("tag").isin(*names)).groupBy(id_col, "tag", "text").agg(F.min("start").alias("at"))
    per = per.groupBy(id_col, "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("v"))
    return per.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.element_at(label, F.col("tag")).alias("k"), "v")))).alias("lists"))


#: Kinds of schools, beginnings of what is done with them, and words before the place of one.
SCHOOLS = ("collège", "lycée", "académie", "faculté", "école", "ecole", "établissement", "institut")
OPERATIONS = ("nomination", "affectation", "concession", "érection", "suppression", "transformation")
BEFORE_PLACE = ("à", "de", "l'", "d'", "'", "du", "la")


def official_acts(df: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """(id, loc, org, basic_org, operation) of texts of official journals. ``found``: their entities LOC and ORG. The last word
    of an organisation is a place if a word such as "de" stands before it; organisations with a last word of one or two
    letters are none."""
    empty = F.array().cast("array<string>")
    words = F.split(F.lower(text_col), " ")
    started = F.filter(F.transform(words, lambda w: F.regexp_extract(w, f"^({'|'.join(OPERATIONS)})", 1)), lambda x: x != "")
    acts = df.select(id_col, F.coalesce(F.array_distinct(started), empty).alias("operation"))
    parts = F.split("text", " ")
    orgs = found.filter("tag = 'ORG'").filter(F.length(F.element_at(parts, -1)) > 2)
    place = orgs.filter((F.size(parts) > 1) & F.try_element_at(parts, F.lit(-2)).isin(*BEFORE_PLACE)).select(id_col, "start", F.lit(1).alias("k"), F.element_at(parts, -1).alias("x"))
    locs = found.filter("tag = 'LOC'").select(id_col, "start", F.lit(0).alias("k"), F.col("text").alias("x")).unionAll(place)
    basic = orgs.select(id_col, "start", F.regexp_extract(F.lower("text"), f"^({'|'.join(SCHOOLS)})", 1).alias("x")).filter("x != ''")
    in_order = lambda d, name, distinct: (d.groupBy(id_col, "x").agg(F.min("start").alias("start")) if distinct else d).groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "x"))), lambda s: s["x"]).alias(name))
    out = acts
    for d, name, distinct in ((locs.select(id_col, "start", "x"), "loc", True), (orgs.select(id_col, "start", F.col("text").alias("x")), "org", True), (basic, "basic_org", False)):
        out = out.join(in_order(d, name, distinct), id_col, "left").withColumn(name, F.coalesce(name, empty))
    return out.select(id_col, "loc", "org", "basic_org", "operation")


def short_pieces(c: Column, most: int = 512) -> Column:
    """A text whole, or cut at full stops if it has ``most`` signs or more: what a tagger with a bound is given."""
    return F.when(F.length(c) >= most, F.split(c, "\\.")).otherwise(F.array(c))
