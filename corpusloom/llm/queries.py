"""The pN_ queries over the test tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.addresses import link_sites, site_pairs, town_names
from corpusloom.llm.canonical import align_values, group_names, list_entries
from corpusloom.llm.langcodes import label_code
from corpusloom.llm.langid import detect_segments, fit_profiles, language_cases
from corpusloom.llm.matching import match_references
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.names import link_profiles, profile_pairs
from corpusloom.llm.repetition import find_repetitive, measure_repetition, measure_units
from corpusloom.llm.tokenize import encode_texts
from corpusloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_references(table(spark, sf_dir, "crossref_works"), table(spark, sf_dir, "bibrefs")).select("work_id", "ref_id")


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match_references(table(spark, sf_dir, "crossref_works"), table(spark, sf_dir, "bibrefs"))
    return rows.select("work_id", "ref_id", F.round("cosine", 4).alias("cosine"), F.round("confidence", 4).alias("confidence"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_pairs(link_profiles(table(spark, sf_dir, "author_profiles")))


def p2_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_profiles(table(spark, sf_dir, "author_profiles"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    towns = town_names(table(spark, sf_dir, "geonames"), ["name", "asciiname"], "alternatenames")
    countries = group_names(table(spark, sf_dir, "countries"), "country_code", ["code3", "name", "local_name"])
    return link_sites(table(spark, sf_dir, "get_id"), towns, countries)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_pairs(_sites(spark, sf_dir))


def p3_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return sites.groupBy("site").agg(F.count(F.lit(1)).alias("n")).join(sites, "site").select("id", "site", (F.col("n") - 1).alias("links"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = list_entries(table(spark, sf_dir, "geonames"), "geonameid", ["name", "asciiname"], "alternatenames", "country_code", "population")
    groups = group_names(table(spark, sf_dir, "countries"), "country_code", ["code3", "name", "local_name"])
    return align_values(table(spark, sf_dir, "align_mentions"), entries, groups)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("mention_id", F.col("entry").alias("geonameid"))


def p4_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("mention_id", F.col("entry").alias("geonameid"), "distance", F.round("confidence", 4).alias("confidence"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "detect_lang")
    return detect_segments(rows, fit_profiles(rows))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_cases(_segments(spark, sf_dir)).select("id", "seg", "lang")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).select("id", "label", F.posexplode_outer("segs").alias("seg", "s"))
    return rows.select("id", "label", "seg", "s.lang", F.round("s.confidence", 4).alias("confidence"), "s.n_words")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.coalesce(label_code(F.col("lang")), F.lit("und")).alias("language"))
    return mix_sources(docs, table(spark, sf_dir, "mix_targets"), levels=("source", "language"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


#: Sources that are no archives of papers, by their domain.
_DOMAINS = {"datapress": "web", "campuswire": "web", "loosefiles": "web", "greyleaf": "grey", "lexarchive": "grey"}


def p7_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mix as large as all documents together: sources that cannot fill theirs pass the rest on, within
    their domain first."""
    domain = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _DOMAINS.items() for x in kv]), F.col("source")), F.lit("papers"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.coalesce(label_code(F.col("lang")), F.lit("und")).alias("language")).withColumn("domain", domain)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return mix_sources(docs, table(spark, sf_dir, "mix_targets"), levels=("domain", "source", "language"), of="source", total=size / 3)[1]


def p8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_units(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repetitive(table(spark, sf_dir, "documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_repetition(table(spark, sf_dir, "documents")).withColumn("share", F.round("share", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_persons, p3_found, p3_sites, p4_found, p4_alignments, p5_found, p5_segments, p6_ids, p7_mix, p7_shares, p7_full, p8_found, p8_shares, p8_units)}


_P8 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '\p{L}+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words
), grams AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ') ORDER BY i) AS nth FROM starts
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM grams WHERE nth > 1) GROUP BY doc_id
), measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated FROM words LEFT JOIN covered USING (doc_id)
)
"""


_UNITS = """
WITH p AS (SELECT doc_id, {k} AS kind, list_filter(list_transform(string_split_regex(coalesce(text, ''), {pattern}), lambda x: array_to_string(regexp_extract_all(lower(nfc_normalize(x)), '\\p{{L}}+'), ' ')), lambda x: x <> '') AS v FROM documents)
SELECT doc_id, kind, CAST(len(v) AS BIGINT) AS n, CAST(len(v) - len(list_distinct(v)) AS BIGINT) AS r FROM p
"""
_P8_UNITS = f"SELECT s.doc_id, s.n AS n_sentences, s.r AS repeated_sentences, p.n AS n_paragraphs, p.r AS repeated_paragraphs FROM ({_UNITS.format(k=1, pattern="'[.!?\\n]+'")}) s JOIN ({_UNITS.format(k=2, pattern="'\\n+'")}) p USING (doc_id)"


def oracle_sql() -> dict[str, str]:
    return {
        "p8_units": _P8_UNITS,
        "p8_found": _P8 + "SELECT doc_id FROM measured WHERE n_words > 0 AND n_repeated >= 0.25 * n_words",
        "p8_shares": _P8 + "SELECT doc_id, n_words, n_repeated, CASE WHEN n_words = 0 THEN 0.0 ELSE round(n_repeated / n_words::DOUBLE, 6) END AS share FROM measured",
    }
