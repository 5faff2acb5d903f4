"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.joins import lookup_any
from corpusloom.plans.registry import query
from corpusloom.session import table

_FOLD = "replace(replace(replace(replace(replace(replace(strip_accents({0}), 'ß', 'ss'), 'œ', 'oe'), 'Œ', 'OE'), 'ø', 'o'), 'ł', 'l'), 'Ł', 'L')"


def _fold(c: str) -> str:
    return _FOLD.format(c)


@query(f"SELECT geonameid, {_fold('name')} AS value FROM geonames")
def no_accent(spark, d):
    return table(spark, d, "geonames").select("geonameid", T.deburr(F.col("name")).alias("value"))


@query(f"SELECT geonameid, strip_accents(nfc_normalize(name)) AS value FROM geonames")
def no_accent_any_script(spark, d):
    return table(spark, d, "geonames").select("geonameid", T.strip_marks(F.col("name")).alias("value"))


@query(rf"SELECT geonameid, upper(trim(regexp_replace({_fold('name')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS value FROM geonames")
def normalize_terms(spark, d):
    return table(spark, d, "geonames").select("geonameid", T.normalize_term(F.col("name")).alias("value"))


_BARE = r"regexp_replace(name, '[\p{P}\p{S}\s]+', '', 'g')"


@query(f"SELECT geonameid, lower({_fold(_BARE)}) AS value FROM geonames")
def label_keys(spark, d):
    return table(spark, d, "geonames").select("geonameid", T.label_key(F.col("name")).alias("value"))


@query(rf"SELECT DISTINCT id, trim(regexp_replace(lower({_fold('value')}), '[^a-z0-9]+', ' ', 'g')) AS value FROM get_id")
def uniform_addresses(spark, d):
    return table(spark, d, "get_id").select("id", T.uniformize(F.col("value")).alias("value")).distinct()


@query(rf"""
WITH u AS (SELECT DISTINCT id, string_split(trim(regexp_replace(lower({_fold('value')}), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM get_id)
SELECT id, array_to_string(list_filter(list_transform(w, lambda x: CASE WHEN x IN ('universite', 'university', 'universitaire') THEN 'univ' WHEN x IN ('centre', 'center') THEN 'ctr' ELSE x END),
  lambda x: x NOT IN ('france', 'franc', 'fr', '')), ' ') AS value FROM u
""")
def normal_affiliations(spark, d):
    return table(spark, d, "get_id").select("id", T.normalize_affiliation(F.col("value")).alias("value")).distinct()


@query(r"""
SELECT DISTINCT ref_id, CASE WHEN doi <> '' THEN lower(doi) END AS doi, CASE WHEN y <> '' THEN CAST(y AS INT) END AS year, CASE WHEN y <> '' THEN TRUE ELSE FALSE END AS dated FROM (
  SELECT ref_id, regexp_extract(raw_ref, '(?i)\b(10\.\d{4,9}/[^\s"<>]+?)[.,;)\]]*(?:\s|$)', 1) AS doi, regexp_extract(regexp_replace(raw_ref, '\d{5,}', '#', 'g'), '(?:^|\D)((?:19|20)\d{2})(?:\D|$)', 1) AS y FROM bibrefs)
""")
def reference_identifiers(spark, d):
    raw = F.regexp_replace("raw_ref", "\\d{5,}", "#")
    year = T.find_year(raw)
    return table(spark, d, "bibrefs").select("ref_id", T.find_doi(F.col("raw_ref")).alias("doi"), year.alias("year"), year.isNotNull().alias("dated")).distinct()


@query(r"SELECT work_id, split_part(doi, '/', 1) AS prefix FROM (SELECT DISTINCT work_id, doi FROM crossref_works)")
def identifier_prefixes(spark, d):
    return table(spark, d, "crossref_works").select("work_id", T.doi_prefix(F.col("doi")).alias("prefix")).distinct()


@query(r"""
SELECT DISTINCT work_id, trim(regexp_replace(regexp_replace(title, '<[^>]{1,60}>', '', 'g'), '(?i)^\s*(?:retracted(?: article)?|retraction(?: note)?|withdrawn)\s*:\s*', '')) AS title FROM crossref_works
""")
def clean_titles(spark, d):
    return table(spark, d, "crossref_works").select("work_id", T.clean_title(F.col("title")).alias("title")).distinct()


@query("SELECT doc_id, regexp_replace(text, '[0-9]', '', 'g') AS letters, TRUE AS back FROM documents WHERE text IS NOT NULL")
def digits_round_trip(spark, d):
    rows = table(spark, d, "documents").filter("text is not null")
    back = T.decode_digits(T.encode_digits(F.col("text"), "xinf", "supx"), "xinf", "supx")
    return rows.select("doc_id", F.regexp_replace("text", "[0-9]", "").alias("letters"), (back == F.col("text")).alias("back"))


@query(r"""
SELECT p_partkey, upper(substr(v, 1, 1)) || substr(v, 2) AS value FROM (
  SELECT p_partkey, trim(array_to_string(w[1:len(w) - 1], ' ') || ' ' || CASE
    WHEN regexp_matches(w[-1], '(?i)(ss|us|is)$') THEN w[-1] WHEN regexp_matches(w[-1], '(?i)([^aeiou])ies$') THEN regexp_replace(w[-1], '(?i)([^aeiou])ies$', '\1y')
    WHEN regexp_matches(w[-1], '(?i)(x|ch|sh|ss|zz)es$') THEN regexp_replace(w[-1], '(?i)(x|ch|sh|ss|zz)es$', '\1') WHEN regexp_matches(w[-1], '(?i)(ive)s$') THEN regexp_replace(w[-1], '(?i)(ive)s$', '\1')
    WHEN regexp_matches(w[-1], '(?i)([lr])ves$') THEN regexp_replace(w[-1], '(?i)([lr])ves$', '\1f') WHEN regexp_matches(w[-1], '(?i)s$') THEN regexp_replace(w[-1], '(?i)s$', '') ELSE w[-1] END) AS v
  FROM (SELECT p_partkey, p_name, string_split(lower(trim(regexp_replace(p_name, '[\p{P}\p{S}\s]+', ' ', 'g'))), ' ') AS w FROM part))
""")
def clean_keywords(spark, d):
    return table(spark, d, "part").select("p_partkey", T.humanize(F.col("p_name")).alias("value"))


@query(r"""
SELECT DISTINCT profile_id, list_distinct([f || ' ' || l, l || ' ' || f, l || ', ' || f, substr(f, 1, 1) || '. ' || l, l || ' ' || substr(f, 1, 1), l || ', ' || substr(f, 1, 1) || '.']).list_sort().array_to_string('|') AS variants
FROM (SELECT profile_id, trim(firstName) AS f, trim(lastName) AS l FROM author_profiles WHERE firstName IS NOT NULL AND lastName IS NOT NULL)
""")
def name_forms(spark, d):
    rows = table(spark, d, "author_profiles").filter("firstName is not null and lastName is not null")
    return rows.select("profile_id", F.array_join(F.array_sort(T.name_variants(F.col("firstName"), F.col("lastName"))), "|").alias("variants")).distinct()


@query("SELECT o_orderkey, abs(o_custkey % 97 - o_orderkey % 89) + 1 AS pages FROM orders")
def page_counts(spark, d):
    text = F.concat_ws("-", (F.col("o_custkey") % 97).cast("string"), (F.col("o_orderkey") % 89).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", T.page_count(text).alias("pages"))


@query(r"""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL AND length(text) > 0)
SELECT doc_id, array_to_string(ws, ' ') AS text FROM w
""")
def inverted_index_texts(spark, d):
    rows = table(spark, d, "documents").filter("text is not null and length(text) > 0").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "w"))
    index = rows.groupBy("doc_id", "w").agg(F.collect_list("at").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("doc_id", T.inverted_to_text(F.col("m")).alias("text"))


_GREEK, _SOLID = r"'[\x{0370}-\x{03E1}\x{03F0}-\x{03FF}]'", r"'[^\t\n\x0b\f\r ]'"


@query(rf"""
WITH d AS (SELECT doc_id, text, len(regexp_extract_all(text, {_SOLID})) AS solid FROM documents),
p AS (SELECT doc_id, i, string_split(text, '.')[i] AS s FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, '.')) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
k AS (SELECT doc_id, string_agg(s || '.', '' ORDER BY i) AS kept FROM p WHERE trim(s) <> '' AND len(regexp_extract_all(s, {_GREEK})) < 0.3 * greatest(1, len(regexp_extract_all(s, {_SOLID}))) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN solid > 0 THEN round(len(regexp_extract_all(text, {_GREEK})) / solid, 6) END AS share, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS kept FROM d LEFT JOIN k USING (doc_id)
""")
def greek_signs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.greek_share(F.col("text")), 6).alias("share"), T.without_greek(F.col("text")).alias("kept"))


_ENDS = r"""string_split_regex(regexp_replace(text, '([.!?])[\t\n\x0b\f\r ]+([\p{Lu}\p{N}])', '\1' || chr(1) || '\2', 'g'), '\x01|\n{2,}')"""


@query(rf"""
SELECT doc_id, len(list_filter({_ENDS}, lambda s: trim(s, ' ') <> '')) AS sentences, list_filter(list_transform({_ENDS}, lambda s: trim(s, ' ')), lambda s: s <> '')[1] AS first FROM documents WHERE text IS NOT NULL
""")
def sentence_counts(spark, d):
    parts = T.sentences(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(parts).cast("bigint").alias("sentences"), F.try_element_at(parts, F.lit(1)).alias("first"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(rf"""
WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\bArt. [0-9A-Za-z_]*\b', '', 'g'), '\.\.+', '', 'g') AS t FROM documents)
SELECT doc_id, {"replace(" * len(T.SCAN_FAULTS)}t{"".join(f", {_quoted(a)}, {_quoted(b)})" for a, b in T.SCAN_FAULTS)} AS text FROM x
""")
def cleaned_scans(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_scan(F.col("text")).alias("text"))


_UNITS = "|".join(T.UNITS.values())


@query(rf"""
WITH q AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{{L}}0-9.-])[0-9]+(?:[.,][0-9]+)?[\t\n\x0b\f\r ]?(?:{_UNITS})(?:[^\p{{L}}0-9]|$)')) AS m FROM documents)
SELECT doc_id, regexp_extract(m, '([0-9]+(?:[.,][0-9]+)?)', 1) AS quantity, regexp_extract(m, '[0-9][\t\n\x0b\f\r ]?({_UNITS})(?:[^\p{{L}}0-9]|$)', 1) AS unit, count(*) AS n FROM q GROUP BY ALL
""")
def measured_quantities(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.quantities(F.col("text"))).alias("q"))
    return rows.groupBy("doc_id", "q.quantity", "q.unit").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH w AS (SELECT DISTINCT id, value, list_transform(string_split_regex(replace(lower(value), ',', ''), '[\t\n\x0b\f\r ]+'), lambda x: trim(x, '().')) AS w FROM get_id),
h AS (SELECT *, list_filter(w, lambda x: x IN ('sas', 'sarl', 'sa', 'private', 'edf', 'orange') OR starts_with(x, 'univ') OR starts_with(x, 'hop') OR starts_with(x, 'hôp') OR starts_with(x, 'hosp') OR starts_with(x, 'uar') OR starts_with(x, 'umr') OR starts_with(x, 'cea') OR starts_with(x, 'cnrs'))[1] AS h FROM w)
SELECT id, trim(string_split(lower(value), ',')[1], ' ') AS organisme, CASE WHEN h IS NULL THEN 'n/a' WHEN h IN ('sas', 'sarl', 'sa', 'private', 'edf', 'orange') THEN 'private' ELSE 'public' END AS statut FROM h
""")
def public_or_private(spark, d):
    value = F.col("value")
    return table(spark, d, "get_id").select("id", T.organisation_name(value).alias("organisme"), T.first_token_kind(value).alias("statut")).distinct()


@query(rf"""
WITH n AS (SELECT DISTINCT profile_id, firstName AS f, replace(firstName, chr(39), '') AS q FROM author_profiles),
k AS (SELECT profile_id, CASE WHEN f IS NULL OR regexp_matches(q, '^([A-Z][. -]+){{2,}}[A-Z]*') OR regexp_matches(q, '^[A-Z]+(?:[^\p{{L}}\p{{N}}_]|$)') THEN [] ELSE string_split_regex(replace(replace(lower({_fold("q")}), '.', ''), '- ', '-'), '[,\t\n\x0b\f\r -]+') END AS p FROM n),
c AS (SELECT profile_id, CASE WHEN len(p) = 1 THEN [p[1]] WHEN len(p) > 1 AND length(p[1]) > 1 AND length(p[2]) > 1 THEN [p[1] || p[2], p[1] || '-' || p[2], p[1] || ' ' || p[2], p[1]] WHEN len(p) > 1 AND length(p[1]) > 1 THEN [p[1]] ELSE [] END AS keys FROM k),
l AS (SELECT lower({_fold("split_part(firstName, ' ', 1)")}) AS name, ['M', '1M', '?M', 'F', '1F', '?F', '?', 'x'][CAST(length(split_part(firstName, ' ', 1)) % 8 AS INT) + 1] AS code FROM author_profiles WHERE length(split_part(firstName, ' ', 1)) > 3 GROUP BY ALL),
u AS (SELECT name, min(code) AS code FROM l GROUP BY 1), t AS (SELECT profile_id, unnest(keys) AS name, unnest(range(1, len(keys) + 1)) AS pos FROM c), h AS (SELECT profile_id, arg_min(code, pos) AS code FROM t JOIN u USING (name) GROUP BY 1)
SELECT c.profile_id, CASE code WHEN 'M' THEN 'masculin' WHEN '1M' THEN 'mixte_masculin' WHEN '?M' THEN 'mixte_masculin' WHEN 'F' THEN 'feminin' WHEN '1F' THEN 'mixte_feminin' WHEN '?F' THEN 'mixte_feminin' WHEN '?' THEN 'mixte' ELSE 'n/a' END AS gender FROM c LEFT JOIN h USING (profile_id)
""")
def first_name_genders(spark, d):
    rows = table(spark, d, "author_profiles").select("profile_id", "firstName").distinct()
    head = F.substring_index("firstName", " ", 1)
    code = F.element_at(F.array(*[F.lit(x) for x in ("M", "1M", "?M", "F", "1F", "?F", "?", "x")]), F.length(head) % 8 + 1)
    known = rows.filter(F.length(head) > 3).select(F.lower(T.deburr(head)).alias("name"), code.alias("code")).groupBy("name").agg(F.min("code").alias("code"))
    found = lookup_any(rows, known, "profile_id", T.first_name_keys(F.col("firstName")), "name", "code", name="code")
    return found.select("profile_id", T.gender_label(F.col("code")).alias("gender"))


_TWO = {k: v for a, b in T.CYRILLIC_TWO.items() for k, v in ((a, b), (a.upper(), b.upper()))}


@query(rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+') AS w FROM documents)
SELECT doc_id, CASE WHEN w IS NOT NULL THEN array_to_string(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '[CСMМ]*[XVIХІ]+') THEN translate(x, '{T.LOOK_CYRILLIC}', '{T.LOOK_LATIN}')
  ELSE {"replace(" * len(_TWO)}translate(translate(x, '{T.LOOK_LATIN}', '{T.LOOK_CYRILLIC}'), '{T.CYRILLIC + T.CYRILLIC.upper()}', '{T.LATIN + T.LATIN.upper()}'){"".join(f", '{k}', '{v}')" for k, v in _TWO.items())} END), '') END AS latin FROM t
""")
def transliterated(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cyrillic_to_latin(F.col("text")).alias("latin"))


@query(r"""
SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(regexp_replace(text, '(?i)(^|[^\p{L}\p{N}])([cdjlmnstç]|qu|jusqu|lorsqu|puisqu)[''’]', '\1\2'' ', 'g'), '([.,;:!?()«»"\[\]])', ' \1 ', 'g'), '[ \t\r\n\f\x0b]+'), lambda w: w <> '')) AS tokens
FROM documents WHERE text IS NOT NULL
""")
def french_token_counts(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(T.french_tokens(F.col("text"))).cast("bigint").alias("tokens"))
