"""Entities, decision rules, resolvers and derived fields over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import language as G
from corpusloom.functions import records as C
from corpusloom.operators import alignment as N
from corpusloom.operators import decisions as D
from corpusloom.operators import entities as E
from corpusloom.operators import joins as J
from corpusloom.operators import resolvers as V
from corpusloom.plans.registry import query
from corpusloom.session import table


def _tokens(spark, d):
    """Words of texts with a tag by their first letter and length, as a tagger might give them."""
    words = table(spark, d, "documents").filter("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    tag = lambda t: F.when(t.rlike("^\\p{Lu}"), F.element_at(F.array(F.lit("PER"), F.lit("LOC"), F.lit("ORG")), F.length(t) % 3 + 1)).otherwise("O")
    rows = words.select("doc_id", "w", F.transform("w", tag).alias("t"), F.transform("w", lambda t: 0.5 + (F.length(t) % 5) / 10).alias("s"))
    return E.tagged_tokens(rows, "doc_id", "w", "t", "s")


_SPANS = r"""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, unnest(range(0, len(string_split(text, ' ')))) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, CASE WHEN regexp_matches(token, '^\p{Lu}') THEN ['PER', 'LOC', 'ORG'][CAST(length(token) % 3 AS INT) + 1] ELSE 'O' END AS tag, 0.5 + (length(token) % 5) / 10 AS score FROM w),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, tag ORDER BY pos) AS island FROM t),
s AS (SELECT doc_id, min(pos) AS start, string_agg(token, ' ' ORDER BY pos) AS text, tag, avg(score) AS score FROM i WHERE tag <> 'O' GROUP BY doc_id, tag, island)
"""


@query(_SPANS + r"SELECT doc_id, CAST(start AS INT) AS start, text, tag, round(score, 6) AS score FROM s WHERE score > 0.7 + 1e-12 AND length(trim(text, ' ')) BETWEEN 2 AND 99 AND regexp_matches(text, '[\p{L}\p{N}]')")
def entity_spans(spark, d):
    return E.sure_spans(E.spans(_tokens(spark, d), "doc_id"), 0.7 + 1e-12).withColumn("score", F.round("score", 6))


@query(None)
def person_entities(spark, d):
    return E.person_spans(_tokens(spark, d), "doc_id").withColumn("score", F.round("score", 6))


@query(None)
def repaired_entities(spark, d):
    rows = _tokens(spark, d)
    pieces = rows.withColumn("token", F.when(F.length("token") % 4 == 0, F.concat(F.lit("##"), "token")).otherwise(F.col("token"))).withColumn("tag", F.when(F.col("tag") == "O", "O").otherwise(F.concat(F.lit("B-"), "tag")))
    out = E.repaired_spans(pieces, "doc_id").withColumn("text", E.curated(F.col("text"))).filter("text is not null")
    return E.first_of_kind(out, "doc_id").select("doc_id", "start", "text", "tag")


@query(_SPANS + """, f AS (SELECT doc_id, tag, text, min(start) AS pos FROM s GROUP BY 1, 2, 3)
SELECT doc_id, CASE tag WHEN 'PER' THEN 'persons' WHEN 'LOC' THEN 'places' END AS name, list(text ORDER BY pos, text) AS entities FROM f WHERE tag IN ('PER', 'LOC') GROUP BY doc_id, tag
""")
def named_entity_lists(spark, d):
    lists = E.named_lists(E.spans(_tokens(spark, d), "doc_id"), "doc_id", {"PER": "persons", "LOC": "places"})
    return lists.select("doc_id", F.explode("lists").alias("name", "entities"))


@query(None)
def official_journal_acts(spark, d):
    return E.official_acts(table(spark, d, "documents").filter("text is not null"), "doc_id", "text", E.spans(_tokens(spark, d), "doc_id"))


_ENDS = r"""string_split_regex(regexp_replace(text, '([.!?])[\t\n\x0b\f\r ]+([\p{Lu}\p{N}])', '\1' || chr(1) || '\2', 'g'), '\x01|\n{2,}')"""


@query(rf"""
SELECT doc_id, coalesce(list_filter(list_transform({_ENDS}, lambda s: trim(s, ' ')), lambda s: length(s) BETWEEN 7 AND 500 AND contains(s, ' a')), []) AS sentences FROM documents
""")
def method_sentences(spark, d):
    return D.chosen_sentences(table(spark, d, "documents"), "doc_id", "text", lambda ts: [("1" if " a" in t else "0", 0.9) for t in ts])


@query("""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN contains(coalesce(text, ''), 'e') THEN 'e' ELSE 'z' END AS a FROM documents),
y AS (SELECT *, CASE WHEN a = 'e' THEN CASE WHEN contains(t, 'qu') THEN 'equ' ELSE 'eno' END END AS b FROM x)
SELECT doc_id, list_filter([a, b, CASE WHEN b = 'equ' THEN CASE WHEN contains(t, 'x') THEN 'equx' ELSE 'equo' END END], lambda c: c IS NOT NULL) AS codes FROM y
""")
def deep_domains(spark, d):
    says = lambda part, yes, no: lambda ts: [(yes if part in t else no, 0.8) for t in ts]
    models = {"": says("e", "e", "z"), "e": says("qu", "equ", "eno"), "equ": says("x", "equx", "equo")}
    return D.deep_cascade(table(spark, d, "documents"), "text", models).select("doc_id", F.transform("levels", lambda x: x["code"]).alias("codes"))


@query("""
WITH w AS (SELECT DISTINCT work_id, title, volume, CASE WHEN work_id % 7 = 0 THEN 'book' ELSE 'journal' END AS kind, ['article', 'review', 'letter'][CAST(work_id % 3 AS INT) + 1] AS item, (work_id % 11) / 10.0 AS p FROM crossref_works),
j AS (SELECT *, CASE WHEN coalesce(regexp_matches(lower(volume), 'sup|meet'), FALSE) OR coalesce(lower(title) LIKE 'retract%', FALSE) THEN 0.0 ELSE p END AS q FROM w)
SELECT work_id, CASE WHEN kind <> 'journal' OR item NOT IN ('article', 'review') THEN 'not_processed' WHEN q >= 0.5 THEN 'true' ELSE 'false' END AS label,
  round(CASE WHEN kind <> 'journal' OR item NOT IN ('article', 'review') THEN 1.0 WHEN q >= 0.5 THEN q ELSE 1 - q END, 6) AS score FROM j
""")
def research_documents(spark, d):
    w = table(spark, d, "crossref_works").select("work_id", "title", "volume").distinct()
    kind, item = F.when(F.col("work_id") % 7 == 0, "book").otherwise("journal"), F.element_at(F.array(F.lit("article"), F.lit("review"), F.lit("letter")), (F.col("work_id") % 3 + 1).cast("int"))
    r = D.research_document(kind, item, F.col("work_id") % 11 / 10, F.col("volume"), F.lower("title").like("retract%"))
    return w.select("work_id", r.alias("r")).select("work_id", "r.label", F.round("r.score", 6).alias("score"))


@query("""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
x AS (SELECT q.vec_id AS query, p.vec_id AS neighbour, p.label, sqrt(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS dist FROM q, embeddings p WHERE p.vec_id <> q.vec_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), neighbour) AS rank FROM x) WHERE rank <= 50),
v AS (SELECT query, label, sum(1 / greatest(dist, 1e-9)) AS w FROM n GROUP BY 1, 2), s AS (SELECT query, label, w, exp(w - max(w) OVER (PARTITION BY query)) AS e FROM v),
p AS (SELECT query, label, e / sum(e) OVER (PARTITION BY query) AS score, row_number() OVER (PARTITION BY query ORDER BY round(w, 9) DESC, label) AS k FROM s)
SELECT query, label, round(score, 4) AS score FROM p WHERE k = 1
""")
def softmax_classes(spark, d):
    e = table(spark, d, "embeddings")
    near = J.nearest_neighbours(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 50)
    return D.softmax_class(near, e, "vec_id", "label").withColumn("score", F.round("score", 4))


@query(r"""
WITH a AS (SELECT DISTINCT id, coalesce(value, '') || CASE WHEN id % 3 = 0 THEN ' UMR ' || (id % 60) ELSE '' END AS x FROM get_id),
u AS (SELECT 'umr' || s_suppkey AS unit, 'c' || s_suppkey AS code FROM supplier WHERE s_suppkey < 40),
m AS (SELECT id, x, CASE WHEN length(x) % 2 = 0 THEN 'even' ELSE 'odd' END AS label, (length(x) % 10) / 10.0 AS p FROM a)
SELECT m.id, coalesce(CASE WHEN m.id % 3 = 0 THEN (SELECT min(code) FROM u WHERE unit = 'umr' || (m.id % 60)) END, CASE WHEN (1 - exp(-0.4 * CASE label WHEN 'even' THEN 4 ELSE 2 END)) * p >= 0.71 THEN label END, 'n/a') AS code FROM m
""")
def structures_by_code_or_model(spark, d):
    a = table(spark, d, "get_id").select("id", F.concat(F.coalesce("value", F.lit("")), F.when(F.col("id") % 3 == 0, F.concat(F.lit(" UMR "), (F.col("id") % 60).cast("string"))).otherwise("")).alias("x")).distinct()
    units = table(spark, d, "supplier").filter("s_suppkey < 40").select(F.concat(F.lit("umr"), "s_suppkey").alias("unit"), F.concat(F.lit("c"), "s_suppkey").alias("code"))
    seen = spark.createDataFrame([("even", 4), ("odd", 2)], "code string, frequency int")
    return D.structure_codes(a, "id", "x", units, lambda ts: [("even" if len(t) % 2 == 0 else "odd", len(t) % 10 / 10) for t in ts], seen)


@query(r"""
SELECT DISTINCT id, list_filter(list_transform(string_split(value, ';'), lambda x: trim(x, ' ')), lambda x: length(x) >= 3) AS parts, CASE WHEN regexp_matches(lower(value), '\bu[amsrp]{1,3} ?[0-9]+') THEN 'fr' END AS country FROM get_id
""")
def affiliation_fields(spark, d):
    value = F.col("value")
    return table(spark, d, "get_id").select("id", D.affiliation_parts(value).alias("parts"), D.country_of_unit(value).alias("country")).distinct()


@query(r"""
SELECT DISTINCT work_id, CASE WHEN length(b) >= 10 THEN b ELSE '' END AS block FROM (SELECT work_id, trim(replace(replace(split_part('query: ```' || chr(10) || coalesce(title, 'x') || '``` end', '```', 2), chr(10), ' '), '  ', ' '), ' ') AS b FROM crossref_works)
""")
def fenced_blocks(spark, d):
    answer = F.concat(F.lit("query: ```\n"), F.coalesce("title", F.lit("x")), F.lit("``` end"))
    return table(spark, d, "crossref_works").select("work_id", D.fenced_block(answer).alias("block")).distinct()


@query(r"""
SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN len(string_split_regex(trim(text, ' '), '[\t\n\x0b\f\r ]+')) < 30 THEN text ELSE substr(text, 1, 40) || ' <AI-generated>' END AS summary,
  CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'no_abstract' WHEN doc_id % 5 = 0 THEN 'noise' ELSE 'relevant' END AS noise, coalesce(len(string_split(text, '.')) > 1 AND length(text) >= 512, FALSE) AS cut FROM documents
""")
def text_decisions(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", D.summary_text(text, F.substring(text, 1, 40)).alias("summary"), D.noise_label(text, F.col("doc_id") % 5 == 0).alias("noise"), (F.size(E.short_pieces(text)) > 1).alias("cut")
    )


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 3 < 0 OR l_discount < 0 OR l_quantity - 3 > 45 OR l_discount > 0.09 THEN 'off page' WHEN l_tax * 100 < 2 THEN 'tiny' WHEN l_returnflag = 'R' THEN 'white' END AS why FROM lineitem
""")
def hidden_pieces(spark, d):
    colour = F.when(F.col("l_returnflag") == "R", "#FFFFFF").otherwise("#000000")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", D.hidden_text(F.col("l_quantity") - 3, F.col("l_discount"), F.col("l_tax") * 100, colour, F.lit(45.0), F.lit(0.09)).alias("why"))


@query(None)
def aligned_place_names(spark, d):
    g = table(spark, d, "geonames").filter("feature_class = 'P'")
    return D.aligned_places(table(spark, d, "align_mentions").select("mention_id", "name").distinct(), g, "mention_id", "name", "geonameid", "name", choose=F.col("population"))


@query("""
WITH w AS (SELECT lower(doi) AS doi, arg_min({'t': title, 'y': issued, 'p': first_page, 'j': source_short, 'd': doi}, work_id) AS r FROM crossref_works GROUP BY 1),
r AS (SELECT DISTINCT ref_id, '10.' || regexp_extract(lower(raw_ref), '\\b10\\.(\\d{4,9}/[^\\s"<>;,]+)', 1) AS doi FROM bibrefs)
SELECT ref_id, r.r.t AS title, r.r.y AS year, r.r.p AS pages, r.r.j AS journal, r.r IS NOT NULL AS known FROM (SELECT r.ref_id, w.r FROM r LEFT JOIN w USING (doi)) r
""")
def register_shapes(spark, d):
    refs, works = table(spark, d, "bibrefs"), table(spark, d, "crossref_works")
    rows = refs.select("ref_id", F.concat(F.lit("10."), F.regexp_extract(F.lower("raw_ref"), "\\b10\\.(\\d{4,9}/[^\\s\"<>;,]+)", 1)).alias("doi")).distinct()
    shapes = {"full": {"title": F.col("title"), "year": F.col("issued"), "pages": F.col("first_page")}, "open": {"title": F.col("title")}, "flag": {"known": F.lit(True)}, "old": {"doi": F.col("doi"), "journal": F.col("source_short")}}
    for name, shape in shapes.items():
        rows = V.looked_up(rows, works, F.col("doi"), F.lower("doi"), shape, F.col("work_id"), name)
    same = F.when(F.col("full.title").eqNullSafe(F.col("open.title")), F.col("full.title")).otherwise("the shapes differ")
    return rows.select("ref_id", same.alias("title"), F.col("full.year").alias("year"), F.col("full.pages").alias("pages"), F.col("old.journal").alias("journal"), F.coalesce("flag.known", F.lit(False)).alias("known"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def records_of_keys(spark, d):
    return V.each_record(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), F.col("c_custkey"), F.col("o_custkey"), {"o_orderkey": F.col("o_orderkey")})


@query("SELECT DISTINCT work_id, CASE WHEN work_id % 2 = 0 THEN doi ELSE 'hal-' || work_id END AS key, CASE WHEN work_id % 3 = 0 THEN 'txt' WHEN work_id % 3 = 1 THEN 'cleaned' END AS file FROM crossref_works")
def document_keys(spark, d):
    w = table(spark, d, "crossref_works").select("work_id", "doi").distinct()
    doi = F.when(F.col("work_id") % 2 == 0, F.concat(F.lit('<idno type="doi">'), "doi", F.lit("</idno>"))).otherwise('<idno type="doi"> </idno>')
    xml = F.concat(F.lit("<tei><head>"), doi, F.lit('<idno type="own">hal-'), F.col("work_id").cast("string"), F.lit("</idno></head></tei>"))
    kinds = F.when(F.col("work_id") % 3 == 0, F.array(F.lit("pdf"), F.lit("cleaned"), F.lit("txt"))).when(F.col("work_id") % 3 == 1, F.array(F.lit("cleaned"), F.lit("pdf"))).otherwise(F.array(F.lit("zip")))
    files = F.transform(kinds, lambda e: F.struct(e.alias("extension")))
    return w.select("work_id", V.first_path(xml, "tei/head/idno[@type='doi']", "tei/head/idno[@type='own']").alias("key"), V.by_extension(files, "txt", "cleaned")["extension"].alias("file"))


@query("SELECT l_orderkey, list(coalesce(CASE WHEN l_suppkey % 3 > 0 THEN s_name END, CAST(l_suppkey AS VARCHAR)) ORDER BY l_linenumber, l_suppkey) AS labels FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def verbalised_codes(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("v")).select("l_orderkey", F.transform("v", lambda x: x["l_suppkey"].cast("string")).alias("codes"))
    labels = table(spark, d, "supplier").filter("s_suppkey % 3 > 0").select(F.col("s_suppkey").cast("string").alias("code"), "s_name")
    return V.verbalise(rows, "l_orderkey", "codes", labels, "code", "s_name").select("l_orderkey", "labels")


def _vocabulary(spark, d):
    c, g = table(spark, d, "countries"), table(spark, d, "geonames")
    labels = c.select(F.col("name").alias("label"), F.col("country_code").alias("uri")).unionAll(c.select("local_name", "country_code")).unionAll(c.select("code3", "country_code"))
    terms = c.select(F.col("name").alias("value")).union(c.select(F.upper("local_name"))).union(g.select("country_code")).union(spark.range(1).select(F.lit("toto"))).distinct()
    return terms, labels, c.select(F.col("country_code").alias("uri"), F.col("name").alias("label"), "code3", "local_name"), g


_VOCABULARY = r"""
WITH key AS (SELECT lower(strip_accents(regexp_replace(l, '[\p{P}\p{S}\s]+', '', 'g'))) AS k, min(u) AS uri FROM (SELECT name AS l, country_code AS u FROM countries UNION ALL SELECT local_name, country_code FROM countries UNION ALL SELECT code3, country_code FROM countries) GROUP BY 1),
v AS (SELECT name AS value FROM countries UNION SELECT upper(local_name) FROM countries UNION SELECT country_code FROM geonames UNION SELECT 'toto'),
h AS (SELECT v.value, c.* FROM v LEFT JOIN key ON lower(strip_accents(regexp_replace(v.value, '[\p{P}\p{S}\s]+', '', 'g'))) = k LEFT JOIN countries c ON c.country_code = key.uri)
"""


@query(_VOCABULARY + "SELECT value, coalesce(country_code, 'n/a') AS code, coalesce(code3, 'n/a') AS code3, coalesce(local_name, 'n/a') AS local FROM h")
def identified_concepts(spark, d):
    terms, labels, concepts, _ = _vocabulary(spark, d)
    return V.identify_concepts(terms, labels, concepts, "value", {"code": F.col("uri"), "code3": F.col("code3"), "local": F.col("local_name")})


@query(_VOCABULARY + "SELECT value, country_code AS uri, name AS label, CASE WHEN name IS NOT NULL THEN (SELECT count(DISTINCT g.name) FROM geonames g WHERE g.country_code = h.country_code) END AS narrower FROM h")
def expanded_concepts(spark, d):
    terms, labels, concepts, g = _vocabulary(spark, d)
    places = g.select(F.col("geonameid").cast("string").alias("uri"), F.col("name").alias("label"), F.col("country_code").alias("parent"))
    every = concepts.select("uri", "label").unionAll(places.select("uri", "label"))
    out = V.expand_concepts(terms, labels, every, places.select("uri", "parent"), "value")
    return out.select("value", "concept.uri", "concept.label", F.when(F.col("concept").isNotNull(), F.size("concept.narrower").cast("bigint")).alias("narrower"))


@query(r"""
WITH g AS (SELECT trim(regexp_replace(lower(strip_accents(asciiname)), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(country_code), '[^a-z0-9]+', ' ', 'g')) AS c, geonameid, population FROM geonames),
s AS (SELECT n, c, arg_min(geonameid, {'a': -population, 'b': geonameid}) AS entry FROM g GROUP BY 1, 2), y AS (SELECT n, arg_min(geonameid, {'a': -population, 'b': geonameid}) AS entry FROM g GROUP BY 1),
q AS (SELECT geonameid AS id, trim(regexp_replace(lower(strip_accents(asciiname)), '[^a-z0-9]+', ' ', 'g')) AS n, CASE geonameid % 3 WHEN 0 THEN lower(country_code) WHEN 1 THEN '' ELSE 'zz' END AS c FROM geonames)
SELECT q.id, CASE WHEN q.c <> '' THEN s.entry ELSE y.entry END AS entry FROM q LEFT JOIN s ON q.n = s.n AND q.c = s.c LEFT JOIN y ON q.n = y.n
""")
def organisations_by_town(spark, d):
    g = table(spark, d, "geonames")
    town = F.when(F.col("geonameid") % 3 == 0, F.col("country_code")).when(F.col("geonameid") % 3 == 1, "").otherwise("ZZ")
    asked = g.select(F.col("geonameid").alias("id"), F.col("asciiname").alias("a"), town.alias("t"))
    return V.organisation_of(asked, g, F.col("a"), F.col("t"), "geonameid", "asciiname", "country_code", F.col("population")).select("id", "entry")


@query("""
WITH w AS (SELECT DISTINCT work_id, title, issued, volume, first_page, source_long, source_short, CAST(indexed_at AS VARCHAR)[1:10] AS seen FROM crossref_works),
s AS (SELECT *, CASE work_id % 4 WHEN 0 THEN ['unknown', 'repository'] WHEN 1 THEN ['gold'] WHEN 2 THEN ['diamond', 'gold', 'closed'] ELSE ['unknown', 'publisher'] END AS hosts FROM w)
SELECT work_id, CASE WHEN coalesce(nullif(trim(issued), ''), '9999') < coalesce(nullif(trim(seen), ''), '9999') THEN coalesce(nullif(trim(issued), ''), '9999')[1:4] ELSE coalesce(nullif(trim(seen), ''), '9999')[1:4] END AS year,
  source_short IS NOT NULL AND source_short <> '' AS funded, CASE WHEN work_id % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END AS codes, CASE work_id % 4 WHEN 0 THEN ['repository'] WHEN 1 THEN ['gold'] WHEN 2 THEN ['diamond', 'gold', 'closed'] ELSE ['unknown', 'publisher'] END AS hosts,
  array_to_string(list_filter([volume, NULL, first_page], lambda x: x IS NOT NULL AND trim(x) <> ''), ' / ') AS collation, ['x', 'y'] AS chain, CASE WHEN work_id % 2 = 0 THEN ['u'] ELSE ['v'] END AS urls, CASE WHEN work_id % 3 = 0 THEN source_long ELSE 'found' END AS source
FROM s
""")
def derived_fields(spark, d):
    w = table(spark, d, "crossref_works").select("work_id", "title", "issued", "volume", "first_page", "source_long", "source_short", F.date_format("indexed_at", "yyyy-MM-dd").alias("seen")).distinct()
    even, arr = F.col("work_id") % 2 == 0, lambda *xs: F.array(*[F.lit(x) for x in xs])
    hosts = F.when(F.col("work_id") % 4 == 0, arr("unknown", "repository")).when(F.col("work_id") % 4 == 1, arr("gold")).when(F.col("work_id") % 4 == 2, arr("diamond", "gold", "closed")).otherwise(arr("unknown", "publisher"))
    codes = C.kept_codes(F.when(even, arr("a", "", "a")), F.when(even, arr("b")), arr("bad", "c", "c"), ("bad",))
    return w.select(
        "work_id", C.earlier_year(F.col("issued"), F.col("seen")).alias("year"), C.any_of(F.array("source_short")).alias("funded"), codes.alias("codes"), C.without_before(hosts, "unknown", "repository").alias("hosts"),
        C.collation(F.col("volume"), F.lit(None).cast("string"), F.col("first_page")).alias("collation"), C.source_chain(F.lit("x > y >x > ")).alias("chain"), C.fallback_urls(F.when(even, arr("u", "u")), arr("v", "")).alias("urls"),
        C.label_or_own(F.when(F.col("work_id") % 3 == 0, "n/a").otherwise("found"), F.col("source_long")).alias("source"),
    )


@query("""
SELECT o_orderkey, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(38, 2)) AS VARCHAR) AS fixed, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INT) AS year, o_orderstatus IS NOT DISTINCT FROM 'F' AS same, ['a_b', 'c'] AS keys, 'order-' || o_orderkey AS edited, o_orderpriority AS parsed FROM orders
""")
def record_functions(spark, d):
    m = F.create_map(F.lit("a$b"), F.lit(1), F.lit("c"), F.lit(2))
    s = F.struct(F.concat(F.lit("key:"), F.col("o_orderkey").cast("string")).alias("k"))
    return table(spark, d, "orders").select(
        "o_orderkey", C.to_fixed(F.col("o_totalprice"), 2).alias("fixed"), C.year_of(F.col("o_orderdate").cast("date")).alias("year"), C.is_equal(F.col("o_orderstatus"), F.lit("F")).alias("same"), F.map_keys(C.rename_keys(m, "$", "_")).alias("keys"),
        C.edit_json(s, "key:", "order-", "k string")["k"].alias("edited"), C.parse_json(C.stringify(F.struct("o_orderpriority")), "o_orderpriority string")["o_orderpriority"].alias("parsed"),
    )


_NOTICES = """n AS (SELECT DISTINCT 'n' || p_partkey % 40 AS notice, split_part(lower(p_name), ' ', 1 + CAST(p_partkey % 2 AS INT)) AS term FROM part),
i AS (SELECT notice, term, length(term) % 2 = 0 AS ignored FROM n), x AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part),
m AS (SELECT p_partkey, w[k] AS term, k - 1 AS pos, notice FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS k FROM x) JOIN n ON n.term = w[k]),
b AS (SELECT DISTINCT a.notice, a.term FROM i a JOIN i o ON a.notice = o.notice AND a.term <> o.term WHERE o.term IN (SELECT term FROM m)),
g AS (SELECT m.* FROM m JOIN i USING (notice, term) WHERE NOT ignored OR (notice, term) IN (SELECT notice, term FROM b)), c AS (SELECT notice, count(*) AS k FROM g GROUP BY 1),
p AS (SELECT g.*, k, max(k) OVER (PARTITION BY p_partkey, pos) AS m, count(*) OVER (PARTITION BY p_partkey, pos) AS s FROM g JOIN c USING (notice)), f AS (SELECT * FROM p WHERE s = 1 OR m = 1 OR k = m)"""


@query(f"""
WITH {_NOTICES}, t AS (SELECT notice, count(DISTINCT term) AS c FROM f GROUP BY 1), a AS (SELECT notice, count(DISTINCT term) AS t FROM i GROUP BY 1), h AS (SELECT term, count(DISTINCT notice) AS n FROM i GROUP BY 1)
SELECT p_partkey, term, CAST(pos AS INT) AS "at", notice, round(0.7 * pow(c / t, 0.25) + 0.3 * pow(1 / n, 0.5), 3) AS score FROM f JOIN t USING (notice) JOIN a USING (notice) JOIN h USING (term)
""")
def aligned_notices(spark, d):
    part = table(spark, d, "part")
    notices = part.select(F.concat(F.lit("n"), F.col("p_partkey") % 40).alias("notice"), F.get(F.split(F.lower("p_name"), " "), (F.col("p_partkey") % 2).cast("int")).alias("term")).distinct().withColumn("ignored", F.length("term") % 2 == 0)
    found = N.believed_notices(N.without_ignored(N.notice_matches(part, notices, "p_partkey", "p_name"), notices), "p_partkey")
    return N.scored_notices(found, notices).select("p_partkey", "term", "at", "notice", "score")


@query(_SPANS + r""", g AS (SELECT DISTINCT 'g' || doc_id % 7 AS notice, trim(regexp_replace(lower(split_part(title, ' ', 1)), '[^\p{L}\p{N}]+', ' ', 'g')) AS term FROM documents WHERE title IS NOT NULL)
SELECT doc_id, term, CAST(start AS INT) AS "at", notice FROM (SELECT doc_id, start, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS term FROM s WHERE tag = 'LOC') JOIN g USING (term)
""")
def aligned_spans(spark, d):
    notices = table(spark, d, "documents").filter("title is not null").select(F.concat(F.lit("g"), F.col("doc_id") % 7).alias("notice"), F.substring_index("title", " ", 1).alias("term"))
    return N.span_matches(E.spans(_tokens(spark, d), "doc_id"), notices, "doc_id").select("doc_id", "term", "at", "notice")


_LANGS = {lang: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))" for lang, words in G.FUNCTION_WORDS.items()}


@query(r"WITH t AS (SELECT id, string_split_regex(lower(value), '[^\p{L}]+') AS w FROM detect_lang), c AS (SELECT id, " + ", ".join(f"{sql} AS {lang}" for lang, sql in _LANGS.items()) + " FROM t), s AS (SELECT *, " + " + ".join(_LANGS) + " AS n FROM c) SELECT id, CASE " + " ".join(f"WHEN n > 0 AND {lang} / n > 0.85 THEN '{lang}'" for lang in _LANGS) + " ELSE '' END AS lang FROM s")
def languages_by_rule(spark, d):
    return table(spark, d, "detect_lang").select("id", G.detect_language(G.language_shares(F.col("value"))).alias("lang"))


@query(r"""
SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: CASE WHEN w = 'mice' THEN 'mouse' WHEN regexp_matches(w, '(ss|us|is)$') THEN w WHEN regexp_matches(w, '[^aeiou]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(x|ch|sh|ss|zz)es$') THEN regexp_replace(w, 'es$', '')
  WHEN regexp_matches(w, 'ives$') THEN regexp_replace(w, 's$', '') WHEN regexp_matches(w, '[lr]ves$') THEN regexp_replace(w, 'ves$', 'f') ELSE regexp_replace(w, 's$', '') END), ' ') AS lemma FROM part
""")
def word_lemmas(spark, d):
    return table(spark, d, "part").select("p_partkey", G.lemmas(F.replace("p_name", F.lit(" "), F.lit("*")), {"mice": "mouse"}).alias("lemma"))


_FOLDED = "trim(regexp_replace(lower(replace(replace(replace(replace(replace(replace(strip_accents(value), 'ß', 'ss'), 'œ', 'oe'), 'Œ', 'OE'), 'ø', 'o'), 'ł', 'l'), 'Ł', 'L')), '[^a-z0-9]+', ' ', 'g'))"
_LONG = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in G.ADDRESS_WORDS.items())
_ROAD = "((?:street|road|avenue|lane|square|drive|rue|boulevard|route|chemin|place|via|viale|corso|piazza|calle|avenida|plaza|paseo|quai|impasse|allee)(?: (?:de|du|des|la|le|l|d|di|del|della|y))* [a-z]+)"


@query(rf"""
WITH a AS (SELECT DISTINCT id, value FROM get_id), x AS (SELECT id, array_to_string(list_transform(string_split({_FOLDED}, ' '), lambda w: CASE w {_LONG} ELSE w END), ' ') AS t FROM a)
SELECT id, t AS address, nullif(regexp_extract(t, '(?:^| )(\d{{5}})(?: |$)', 1), '') AS postcode,
  coalesce(nullif(regexp_extract(t, '(?:^| )(\d{{1,4}}) {_ROAD}', 1), ''), nullif(regexp_extract(t, '(?:^| ){_ROAD} (?:n |no |nr )?(\d{{1,4}})(?: |$)', 2), '')) AS house_number,
  coalesce(nullif(regexp_extract(t, '(?:^| )(\d{{1,4}}) {_ROAD}', 2), ''), nullif(regexp_extract(t, '(?:^| ){_ROAD} (?:n |no |nr )?(\d{{1,4}})(?: |$)', 1), '')) AS road FROM x
""".replace("\\\\", "\\"))
def parsed_addresses(spark, d):
    rows = table(spark, d, "get_id").select("id", "value").distinct()
    return rows.select("id", G.expand_address(F.col("value")).alias("address"), G.address_parts(F.col("value")).alias("p")).select("id", "address", "p.*")
