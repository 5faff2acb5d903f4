"""Joins over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import joins as J
from corpusloom.operators import references as R
from corpusloom.plans.registry import query
from corpusloom.session import table


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'n/a') AS result FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_first_match(spark, d):
    return J.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer"), "o_custkey", "c_custkey", F.col("c_mktsegment"), default="n/a").select("o_orderkey", "result")


@query("""
WITH m AS (SELECT DISTINCT mention_id, name, country_code FROM align_mentions),
g AS (SELECT lower(name) AS k, min(geonameid) AS v FROM geonames GROUP BY 1), a AS (SELECT lower(asciiname) AS k, min(geonameid) AS v FROM geonames GROUP BY 1)
SELECT mention_id, coalesce(g.v, a.v, -1) AS result FROM m LEFT JOIN g ON lower(m.name) = g.k LEFT JOIN a ON replace(lower(m.name), ' ', '-') = a.k
""")
def lookup_by_priority(spark, d):
    m = table(spark, d, "align_mentions").select("mention_id", "name").distinct()
    g = table(spark, d, "geonames")
    keys = g.select(F.lower("name").alias("k"), F.lit("n").alias("s"), "geonameid").unionAll(g.select(F.lower("asciiname"), F.lit("a"), "geonameid"))
    keys = keys.groupBy(F.concat_ws(":", "s", "k").alias("k")).agg(F.min("geonameid").alias("v"))
    tried = F.array(F.concat(F.lit("n:"), F.lower("name")), F.concat(F.lit("a:"), F.replace(F.lower("name"), F.lit(" "), F.lit("-"))))
    return J.lookup_any(m, keys, "mention_id", F.coalesce(tried, F.array().cast("array<string>")), "k", "v", default=-1).select("mention_id", "result")


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS member FROM orders")
def membership_flags(spark, d):
    return J.flag_member(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey"), "o_custkey").select("o_orderkey", "member")


@query("""
SELECT l_orderkey AS id, list(l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) ORDER BY l_linenumber, l_partkey) AS members FROM lineitem GROUP BY l_orderkey
""")
def membership_in_arrays(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("v"))
    rows = rows.select("id", F.transform("v", lambda s: s["l_partkey"]).alias("v"))
    return J.flag_members(rows, table(spark, d, "part").filter("p_size < 10").select("p_partkey"), "id", "v").select("id", "members")


_KEY = r"lower(replace(replace(replace(replace(replace(replace(strip_accents(regexp_replace({0}, '[\p{{P}}\p{{S}}\s]+', '', 'g')), 'ß', 'ss'), 'œ', 'oe'), 'Œ', 'OE'), 'ø', 'o'), 'ł', 'l'), 'Ł', 'L'))"


@query(f"""
WITH l AS (SELECT {_KEY.format('label')} AS k, min(uri) AS uri FROM (SELECT name AS label, country_code AS uri FROM countries UNION ALL SELECT local_name, country_code FROM countries UNION ALL SELECT code3, country_code FROM countries) GROUP BY 1),
m AS (SELECT country_code AS c FROM geonames UNION SELECT name FROM countries UNION SELECT upper(local_name) FROM countries UNION SELECT 'toto')
SELECT m.c AS value, l.uri AS uri, coalesce(countries.name, 'n/a') AS concept FROM m LEFT JOIN l ON {_KEY.format('m.c')} = l.k LEFT JOIN countries ON countries.country_code = l.uri
""")
def vocabulary_resolved(spark, d):
    c = table(spark, d, "countries")
    labels = c.select(F.col("name").alias("label"), F.col("country_code").alias("uri")).unionAll(c.select("local_name", "country_code")).unionAll(c.select("code3", "country_code"))
    terms = table(spark, d, "geonames").select(F.col("country_code").alias("value")).union(c.select("name")).union(c.select(F.upper("local_name"))).union(spark.range(1).select(F.lit("toto"))).distinct()
    return J.resolve(terms, labels, c.select(F.col("country_code").alias("uri"), F.col("name").alias("label")), "value")


@query("SELECT c.c_custkey AS uri, n.n_name AS up1, r.r_name AS up2 FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def broader_concepts(spark, d):
    cust, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    c = cust.select(F.col("c_custkey").cast("string").alias("uri"))
    up = cust.join(nation, cust["c_nationkey"] == nation["n_nationkey"]).select(F.col("c_custkey").cast("string").alias("uri"), F.col("n_name").alias("parent"))
    up = up.unionAll(nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("uri"), F.col("r_name").alias("parent")))
    return J.broader(c, up).withColumn("uri", F.col("uri").cast("bigint"))


@query("""
SELECT g.id, g.y AS year, v.code FROM (SELECT DISTINCT id, try_cast(pub_year AS INT) AS y FROM get_id) g
LEFT JOIN (SELECT s_suppkey, 1950 + CAST(s_suppkey % 60 AS INT) AS a, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 1970 + CAST(s_suppkey % 60 AS INT) END AS b, s_name AS code FROM supplier) v ON g.id % 100 = v.s_suppkey % 100
WHERE v.code IS NULL OR (v.a <= g.y AND (v.b IS NULL OR g.y <= v.b))
""")
def valid_in_year(spark, d):
    g = table(spark, d, "get_id").select("id", F.expr("try_cast(pub_year as int)").alias("year")).distinct().withColumn("k", F.col("id") % 100)
    v = table(spark, d, "supplier").select((F.col("s_suppkey") % 100).alias("k"), (1950 + F.col("s_suppkey") % 60).cast("int").alias("a"), F.when(F.col("s_suppkey") % 3 != 0, (1970 + F.col("s_suppkey") % 60).cast("int")).alias("b"), F.col("s_name").alias("code"))
    return J.in_period(g, v, "k", "year", "a", "b", "code").select("id", "year", "code")


@query("""
SELECT p.event_id, v.value AS last_value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def as_of_values(spark, d):
    e = table(spark, d, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value")).withColumnRenamed("ts", "t")
    return J.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "t", "last_value").select("event_id", "last_value")


@query(r"""
WITH t AS (SELECT p_partkey, list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM part),
r AS (SELECT p_partkey, n, unnest(range(0, len(w) - n + 1)) AS pos, w FROM t, (SELECT DISTINCT len(string_split(trim(regexp_replace(lower(p_type), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS n FROM part UNION SELECT 1) WHERE len(w) >= n),
k AS (SELECT p_partkey, n, pos, array_to_string(w[pos + 1:pos + n], ' ') AS term FROM r),
d AS (SELECT DISTINCT trim(regexp_replace(lower(p_type), '[^\p{L}\p{N}]+', ' ', 'g')) AS term FROM part UNION SELECT DISTINCT split_part(lower(p_name), ' ', 1) FROM part)
SELECT p_partkey, term, CAST(pos AS INT) AS "at", CAST(n AS INT) AS n FROM k JOIN d USING (term)
""")
def dictionary_in_texts(spark, d):
    part = table(spark, d, "part")
    terms = part.select(F.col("p_type").alias("term")).unionAll(part.select(F.split(F.lower("p_name"), " ")[0])).distinct()
    return J.contained_terms(part, terms, "p_partkey", "p_name", "term")


@query(r"""
WITH names AS (SELECT DISTINCT lower(name) AS t FROM geonames UNION SELECT DISTINCT lower(asciiname) FROM geonames)
SELECT a.t AS ta, b.t AS tb FROM names a JOIN names b ON substr(a.t, 1, 4) = substr(b.t, 1, 4) AND a.t < b.t AND strip_accents(a.t) = strip_accents(b.t) AND length(a.t) > 9
""")
def alike_names(spark, d):
    g = table(spark, d, "geonames")
    names = g.select(F.lower("name").alias("t")).union(g.select(F.lower("asciiname"))).distinct()
    from corpusloom.functions.text import deburr

    pairs = J.blocked_similarity(names.withColumn("id", F.lit(0)), "id", "t", prefix=4, least=0.6)
    return pairs.filter((deburr(F.col("ta")) == deburr(F.col("tb"))) & (F.length("ta") > 9)).select("ta", "tb")


@query("""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
x AS (SELECT q.vec_id AS query, p.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS dist FROM q, embeddings p WHERE p.vec_id <> q.vec_id),
r AS (SELECT query, neighbour, round(dist, 4) AS distance, CAST(row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), neighbour) AS INT) AS rank FROM x)
SELECT query, neighbour, distance, rank FROM r WHERE rank <= 5
""")
def nearest_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return J.nearest_neighbours(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 4))


@query("""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
x AS (SELECT q.vec_id AS query, p.vec_id AS neighbour, p.label, sqrt(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS dist FROM q, embeddings p WHERE p.vec_id <> q.vec_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), neighbour) AS rank FROM x) WHERE rank <= 50),
v AS (SELECT query, label, sum(1 / greatest(dist, 1e-9)) AS weight FROM n GROUP BY 1, 2)
SELECT query, label, round(weight, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(weight, 9) DESC, label) AS k FROM v) WHERE k = 1
""")
def nearest_class(spark, d):
    e = table(spark, d, "embeddings")
    near = J.nearest_neighbours(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 50)
    return J.knn_classes(near, e, "vec_id", "label").withColumn("weight", F.round("weight", 4))


_UNIFORM = "trim(regexp_replace(lower(" + _KEY.split("regexp_replace({0}")[0].removeprefix("lower(") + "{0}" + _KEY.split("'g')")[1].removesuffix(")") + "), '[^a-z0-9]+', ' ', 'g'))"
_BARE_TITLE = r"trim(regexp_replace(regexp_replace(coalesce(title, ''), '<[^>]{1,60}>', '', 'g'), '(?i)^\s*(?:retracted(?: article)?|retraction(?: note)?|withdrawn)\s*:\s*', ''))"
_SHARE = "coalesce(len(list_filter(list_distinct(list_filter(string_split({p}, ' '), lambda w: length(w) > 2)), lambda w: list_contains(string_split({t}, ' '), w))) / nullif(len(list_distinct(list_filter(string_split({p}, ' '), lambda w: length(w) > 2))), 0), 0)"


@query(rf"""
WITH w AS (SELECT lower(doi) AS doi, {_UNIFORM.format(_BARE_TITLE)} AS wt, {_UNIFORM.format("coalesce(author[1].family, '')")} AS wa, try_cast(issued AS INT) AS wy, {_UNIFORM.format("coalesce(source_long, '')")} AS ws, work_id FROM crossref_works),
bad AS (SELECT DISTINCT lower(doi) AS doi FROM crossref_works WHERE lower(title) LIKE 'retract%'),
r AS (SELECT ref_id, min(raw_ref) AS t FROM bibrefs GROUP BY 1),
c AS (SELECT ref_id, t, {_UNIFORM.format("coalesce(t, '')")} AS u, try_cast(nullif(regexp_extract(t, '((?:19|20)[0-9]{{2}})', 1), '') AS INT) AS y,
  list_filter(list_transform([lower(regexp_extract(replace(t, ' ', ''), '10\.[0-9]{{4,}}/[^\t\n\x0b\f\r ,]+')), lower(regexp_extract(t, '10\.[0-9]{{4,}}/[^\t\n\x0b\f\r ,]+')), replace(lower(regexp_extract(t, '10\.[0-9]{{4,}}/[^,]+')), ' ', '_')], lambda x: trim(x, '.')), lambda x: x <> '') AS d FROM r),
x AS (SELECT ref_id, t, u, y, unnest(d) AS doi, unnest(range(0, len(d))) AS k FROM c),
h AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY k, work_id) AS n FROM x JOIN w USING (doi)),
s AS (SELECT ref_id, doi, length(doi) * 1.5 < length(u) AS long, (CASE WHEN wt <> '' AND {_SHARE.format(p="wt", t="u")} > 0.84 THEN 1 ELSE 0 END) + (CASE WHEN wa <> '' AND contains(u, wa) THEN 1 ELSE 0 END) + (CASE WHEN wy = y THEN 1 ELSE 0 END) + (CASE WHEN ws <> '' AND {_SHARE.format(p="ws", t="u")} > 0.84 THEN 1 ELSE 0 END) AS p FROM h WHERE n = 1)
SELECT c.ref_id, CASE WHEN NOT long OR p >= 2 THEN s.doi END AS doi, CASE WHEN t IS NULL THEN 'error_data' WHEN s.doi IS NOT NULL AND long AND p < 2 THEN 'to_be_verified' WHEN s.doi IN (SELECT doi FROM bad) THEN 'retracted' WHEN s.doi IS NOT NULL THEN 'found' WHEN len(d) > 0 THEN 'to_be_verified' ELSE 'not_found' END AS status
FROM c LEFT JOIN s USING (ref_id)
""")
def reference_status(spark, d):
    return R.validate_references(table(spark, d, "bibrefs"), *_registers(spark, d), "ref_id", "raw_ref", search=False, similarity=R.word_share)


def _registers(spark, d):
    works = table(spark, d, "crossref_works")
    w = works.select("doi", "title", F.get("author", F.lit(0))["family"].alias("author"), F.expr("try_cast(issued as int)").alias("year"), F.col("source_long").alias("source"))
    return w, works.filter("lower(title) like 'retract%'").select("doi")


@query(None)
def validated_references(spark, d):
    return R.validate_references(table(spark, d, "bibrefs"), *_registers(spark, d), "ref_id", "raw_ref")


@query(None)
def compared_references(spark, d):
    refs = table(spark, d, "bibrefs").select("ref_id", "raw_ref", F.get(R.doi_candidates(F.col("raw_ref")), F.lit(0)).alias("doi")).distinct()
    return R.compare_reference(refs, _registers(spark, d)[0], "ref_id", "raw_ref", "doi")


@query(None)
def matched_researchers(spark, d):
    p = table(spark, d, "author_profiles").select(F.col("profile_id").alias("id"), F.col("firstName").alias("first"), F.col("lastName").alias("last"), "email", "affiliations", F.col("coAuthors").alias("coauthors"), "titles").dropDuplicates(["id"])
    return R.same_researcher(p)


@query("""
SELECT doi, title, count, citing FROM (SELECT lower(citing_doi) AS doi, count(*) AS count, count(DISTINCT author) AS citing FROM bibrefs WHERE citing_doi IS NOT NULL GROUP BY 1)
JOIN (SELECT lower(citing_doi) AS doi, min(raw_ref) AS title FROM bibrefs WHERE raw_ref IS NOT NULL AND trim(raw_ref) <> '' GROUP BY 1) USING (doi) ORDER BY count DESC, doi LIMIT 10
""")
def most_cited(spark, d):
    refs = table(spark, d, "bibrefs")
    return R.top_cited(refs, refs.select(F.col("citing_doi").alias("doi"), F.col("raw_ref").alias("title")), "author", "citing_doi")


@query(r"""
WITH a AS (SELECT DISTINCT id, value FROM get_id), p AS (SELECT id, generate_subscripts(v, 1) AS pos, unnest(v) AS part FROM (SELECT id, string_split_regex(lower(value), '\s*[,;\n]+\s*') AS v FROM a WHERE value IS NOT NULL)),
c AS (SELECT lower(name) AS k, country_code AS v FROM countries UNION SELECT lower(local_name), country_code FROM countries UNION SELECT lower(code3), country_code FROM countries UNION SELECT lower(country_code), country_code FROM countries),
h AS (SELECT id, arg_max(v, pos) AS v FROM p JOIN c ON trim(p.part) = c.k GROUP BY id)
SELECT a.id, coalesce(h.v, 'n/a') AS country FROM (SELECT DISTINCT id FROM a) a LEFT JOIN h USING (id)
""")
def address_countries(spark, d):
    rows = table(spark, d, "get_id").select("id", "value").distinct()
    c = table(spark, d, "countries")
    names = c.select(F.lower("name").alias("k"), F.col("country_code").alias("v"))
    for col in ("local_name", "code3", "country_code"):
        names = names.union(c.select(F.lower(col), "country_code"))
    parts = F.reverse(F.transform(F.split(F.lower("value"), "\\s*[,;\\n]+\\s*"), lambda p: F.trim(p)))
    return J.lookup_any(rows, names.distinct(), "id", F.coalesce(parts, F.array().cast("array<string>")), "k", "v", default="n/a", name="country").select("id", "country")
