"""Terms, abbreviations, species and vocabularies over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import joins as J
from corpusloom.operators import terms as X
from corpusloom.plans.registry import query
from corpusloom.session import table


def _docs(spark, d):
    return table(spark, d, "documents").filter("text is not null")


_SPACE = r"[\t\n\x0b\f\r ]"


def _candidates(lang: str, clitics: str, endings: str, numbers: bool = False) -> str:
    """SQL by words: those that end a term become bars, and what stands between bars is a run."""
    stop = "[" + ", ".join("'" + w + "'" for w in X.STOP_WORDS[lang]) + "]"
    figures = "FALSE" if numbers else r"regexp_matches(x, '\p{N}')"
    return rf"""
t AS (SELECT doc_id, regexp_replace(regexp_replace({clitics}, '[^\p{{L}}\p{{N}}\t\n\x0b\f\r ''’-]+', ' | ', 'g'), '\n{_SPACE}*\n', ' | ', 'g') AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, list_transform(string_split_regex(t, '{_SPACE}+'), lambda x: CASE WHEN x IN ('', '|') OR list_contains({stop}, x) OR {figures}
  OR regexp_full_match(x, '\p{{L}}{{1,{1 if numbers else 2}}}') OR regexp_full_match(x, '[''’-]+') OR regexp_full_match(x, '\p{{L}}[\p{{L}}\p{{N}}''’-]*(?:{endings})') THEN '|' ELSE x END) AS w FROM t),
r AS (SELECT doc_id, unnest(string_split(array_to_string(w, ' '), '|')) AS r FROM w), s AS (SELECT doc_id, trim(r) AS r, string_split(trim(r), ' ') AS v FROM r WHERE trim(r) <> ''),
u AS (SELECT doc_id, unnest(CASE WHEN len(v) = 1 THEN v WHEN len(v) <= 4 THEN list_concat([r], v) ELSE list_concat(list_transform(range(1, len(v) - 2), lambda i: array_to_string(v[i:i + 3], ' ')), v) END) AS term FROM s),
c AS (SELECT * FROM u WHERE length(term) BETWEEN 3 AND 50 AND ({numbers} OR regexp_matches(term, '\p{{L}}')))
"""


_CANDIDATES = _candidates("en", r"regexp_replace(lower(text), '(\p{L})[''’]s([^\p{L}\p{N}]|$)', '\1 | \2', 'g')", "ly|ises|izes|ifies|ing|ed")
_FRENCH = _candidates("fr", r"regexp_replace(lower(text), '(^|[^\p{L}\p{N}])(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu)[''’]', '\1 | ', 'g')", "aient|ait|er|ir|ées?|és?")
_NUMBERS = _candidates("en", r"regexp_replace(lower(text), '(\p{L})[''’]s([^\p{L}\p{N}]|$)', '\1 | \2', 'g')", "ly|ises|izes|ifies|ing|ed", True)


@query(f"WITH {_CANDIDATES} SELECT doc_id, term, count(*) AS frequency FROM c GROUP BY 1, 2")
def term_frequencies(spark, d):
    return X.term_candidates(_docs(spark, d), "doc_id", "text").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("frequency"))


@query(f"""
WITH {_CANDIDATES}, f AS (SELECT doc_id, term, count(*) AS frequency FROM c GROUP BY 1, 2),
k AS (SELECT *, round(frequency / max(frequency) OVER (PARTITION BY doc_id), 4) AS specificity, frequency > 1 OR term LIKE '% %' AS keep, max(CASE WHEN frequency > 1 OR term LIKE '% %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS anyk FROM f)
SELECT doc_id, term, frequency, specificity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, term) AS rank FROM k WHERE keep OR anyk = 0) WHERE rank <= 5
""")
def specific_terms(spark, d):
    return X.specific_terms(_docs(spark, d), "doc_id", "text", top=5)


_RANKED = """f AS (SELECT doc_id, term, count(*) AS frequency FROM c GROUP BY 1, 2),
g AS (SELECT f.*, frequency / coalesce(weight, 1.0) AS sp FROM f LEFT JOIN ref USING (term)),
k AS (SELECT *, round(sp / max(sp) OVER (PARTITION BY doc_id), 4) AS specificity, frequency > 1 OR term LIKE '% %' AS keep, max(CASE WHEN frequency > 1 OR term LIKE '% %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS anyk FROM g)
SELECT doc_id, term, frequency, specificity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sp DESC, frequency DESC, term) AS rank FROM k WHERE keep OR anyk = 0) WHERE rank <= 5"""


@query(f"WITH {_CANDIDATES}, ref AS (SELECT term, 1.0 + log10(count(*)) AS weight FROM c GROUP BY 1 HAVING count(*) > 2), {_RANKED}")
def specific_terms_weighted(spark, d):
    docs = _docs(spark, d)
    reference = X.term_candidates(docs, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").select("term", (1 + F.log10("n")).alias("weight"))
    return X.specific_terms(docs, "doc_id", "text", top=5, reference=reference)


@query(f"WITH {_FRENCH}, ref AS (SELECT '' AS term, 1.0 AS weight), {_RANKED}")
def specific_terms_french(spark, d):
    return X.specific_terms(_docs(spark, d), "doc_id", "text", lang="fr", top=5)


@query(f"WITH {_NUMBERS}, ref AS (SELECT '' AS term, 1.0 AS weight), {_RANKED}")
def specific_terms_with_numbers(spark, d):
    return X.specific_terms(_docs(spark, d), "doc_id", "text", top=5, numbers=True)


@query(f"""
WITH {_CANDIDATES}, o AS (SELECT term, count(*) AS freq, count(DISTINCT doc_id) AS df FROM c GROUP BY 1 HAVING count(*) > 1), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)
SELECT term AS key, freq, round(freq * ln(n / df), 6) AS spec FROM o, n ORDER BY spec DESC, key LIMIT 500
""")
def corpus_terms(spark, d):
    return X.corpus_terms(_docs(spark, d), "doc_id", "text")


@query(r"""
SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '\b(?:catalyst|protein|genome|network)\b'))) AS tools FROM documents WHERE text IS NOT NULL
""")
def tools_in_texts(spark, d):
    return _docs(spark, d).select("doc_id", F.array_sort(X.dictionary_tools(["catalyst", "protein", "genome", "network"], "text")).alias("tools"))


@query("SELECT n_nationkey, n_name || ' City' AS text, 'LOC' AS tag, 0.9 AS score FROM nation WHERE length(n_name) > 0")
def entity_spans(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.array(F.lit("in"), F.col("n_name"), F.lit("City"), F.lit("x")).alias("w"), F.array(*[F.lit(x) for x in ("O", "B-LOC", "I-LOC", "O")]).alias("t"), F.array(*[F.lit(x) for x in (0.2, 0.95, 0.85, 0.9)]).alias("s"))
    return rows.select("n_nationkey", F.explode(X.labelled_spans(rows, "w", "t", "s", 0.7)).alias("a")).select("n_nationkey", "a.text", "a.tag", F.round("a.score", 4).alias("score"))


@query(r"""
WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part), r AS (SELECT p_partkey, n, unnest(range(0, len(w) - n + 1)) AS pos, w FROM t, (SELECT unnest([1, 2]) AS n) WHERE len(w) >= n),
k AS (SELECT p_partkey, n, pos, array_to_string(w[pos + 1:pos + n], ' ') AS term FROM r), d AS (SELECT DISTINCT array_to_string(string_split(lower(p_name), ' ')[1:2], ' ') AS term FROM part UNION SELECT DISTINCT string_split(lower(p_name), ' ')[1] FROM part),
m AS (SELECT k.* FROM k JOIN d USING (term))
SELECT p_partkey, term, CAST(pos AS INT) AS "at", CAST(n AS INT) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.p_partkey = m.p_partkey AND o.pos < m.pos + m.n AND m.pos < o.pos + o.n AND (o.n > m.n OR (o.n = m.n AND o.pos < m.pos)))
""")
def longest_annotations(spark, d):
    part = table(spark, d, "part")
    words = F.split(F.lower("p_name"), " ")
    terms = part.select(F.array_join(F.slice(words, 1, 2), " ").alias("term")).union(part.select(words[0])).distinct()
    return J.longest_match(J.contained_terms(part, terms, "p_partkey", "p_name", "term"), "p_partkey")


@query(r"""
WITH m AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part), c AS (SELECT p_partkey, term, count(*) AS n FROM m GROUP BY 1, 2), d AS (SELECT term, count(DISTINCT p_partkey) AS k FROM m GROUP BY 1)
SELECT p_partkey, term, n AS count, round(0.7 * pow(n / sum(n) OVER (PARTITION BY p_partkey), 0.25) + 0.3 * pow(1.0 / k, 0.5), 6) AS score FROM c JOIN d USING (term)
""")
def scored_matches(spark, d):
    matches = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    return X.score_matches(matches, "p_partkey").withColumn("score", F.round("score", 6))


@query(rf"""
WITH x AS (SELECT DISTINCT id, replace(replace(regexp_replace(value, '(\p{{Lu}})\p{{L}}+ (\p{{Lu}})\p{{L}}+', '\0 (\1\2)', 'g'), '[', '('), ']', ')') AS t FROM get_id WHERE value IS NOT NULL),
y AS (SELECT id, replace(replace(replace(replace(replace(replace(t, '-(', ' ('), ')-', ') '), '((', '('), '))', ')'), '(', ' ('), ')', ') ') AS t FROM x),
w AS (SELECT id, list_filter(string_split_regex(regexp_replace(replace(replace(t, '/', ' '), chr(8201), ' '), '[."'',:\[\]{{}}?!\\+*ʼ·•]', '', 'g'), '{_SPACE}+'), lambda z: z <> '') AS w FROM y),
a AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT id, trim(w[i], '()') AS short, w, i FROM a WHERE regexp_full_match(w[i], '\([\p{{L}}\p{{N}}_&-]{{2,}}\)') AND NOT regexp_full_match(w[i], '\([0-9]+\)') AND NOT contains(w[i], '_'))
SELECT short, array_to_string(w[greatest(1, i - length(short)):i - 1], ' ') AS long, count(*) AS n FROM f GROUP BY ALL
""")
def abbreviations_found(spark, d):
    rows = table(spark, d, "get_id").filter("value is not null").select("id", "value").distinct()
    text = F.translate(F.regexp_replace("value", "(\\p{Lu})\\p{L}+ (\\p{Lu})\\p{L}+", "$0 ($1$2)"), "[]", "()")
    return rows.select(F.explode(T.abbreviations(text)).alias("a")).groupBy("a.short", "a.long").agg(F.count(F.lit(1)).alias("n"))


_TAXA = """taxa AS (SELECT upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || split_part(p_name, ' ', 2) AS name FROM part GROUP BY 1),
x AS (SELECT p_partkey, upper(p_name[1]) || p_name[2:] || ' near ' || upper(p_type[1]) || '. ' || split_part(p_name, ' ', 2) || ' and ' || upper(p_name[1]) || '. ' || split_part(p_name, ' ', 2) AS t FROM part)"""


@query(rf"""
WITH {_TAXA}, f AS (SELECT p_partkey, unnest(regexp_extract_all(t, '(\p{{Lu}}\p{{Ll}}+|\p{{Lu}}\.) (\p{{Ll}}[\p{{Ll}}-]{{2,}})')) AS found FROM x),
full_ AS (SELECT DISTINCT p_partkey, name FROM f JOIN taxa ON found = name),
short AS (SELECT DISTINCT f.p_partkey, g.genus || ' ' || split_part(found, ' ', 2) AS name FROM f JOIN (SELECT DISTINCT p_partkey, split_part(name, ' ', 1) AS genus FROM full_) g ON f.p_partkey = g.p_partkey AND found LIKE '_. %' AND found[1] = g.genus[1])
SELECT * FROM full_ UNION SELECT s.* FROM short s JOIN taxa USING (name)
""")
def species_in_texts(spark, d):
    part = table(spark, d, "part")
    first, second = F.substring_index("p_name", " ", 1), F.split("p_name", " ")[1]
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))
    taxa = part.select(F.concat_ws(" ", capital(first), second).alias("name")).distinct()
    text = F.concat(capital(F.col("p_name")), F.lit(" near "), F.upper(F.substring("p_type", 1, 1)), F.lit(". "), second, F.lit(" and "), F.upper(F.substring("p_name", 1, 1)), F.lit(". "), second)
    return X.species_names(part.select("p_partkey", text.alias("t")), taxa, "p_partkey", "t")
