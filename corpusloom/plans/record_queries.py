"""Statements of the dataflow over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.operators import dataflow as D
from corpusloom.plans.registry import query
from corpusloom.session import table


@query("SELECT c_custkey, c_name, upper(c_mktsegment) AS segment, c_acctbal * 2 AS double_balance FROM customer")
def assign_fields(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return D.assign(rows, segment=F.upper("c_mktsegment"), double_balance=F.col("c_acctbal") * 2).drop("c_mktsegment", "c_acctbal")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS value FROM customer")
def replace_records(spark, d):
    return D.replace(table(spark, d, "customer"), id=F.col("c_custkey").cast("string"), value=F.col("c_name"))


@query("SELECT s_suppkey AS id, s_name AS value FROM supplier")
def exchange_records(spark, d):
    return D.exchange(table(spark, d, "supplier"), F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("value")), spread=True)


@query("SELECT s_name AS value FROM supplier")
def pluck_values(spark, d):
    return D.pluck(table(spark, d, "supplier"), "s_name")


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def keep_fields(spark, d):
    return D.keep(table(spark, d, "supplier"), "s_suppkey", "s_nationkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus = 'F', FALSE)")
def remove_records(spark, d):
    return D.remove(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN concat('!', o_orderpriority) ELSE o_orderpriority END AS o_orderpriority FROM orders")
def swing_values(spark, d):
    rows = table(spark, d, "orders")
    return D.swing(rows, F.col("o_totalprice") > 100000, "o_orderpriority", lambda c: F.concat(F.lit("!"), c)).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def swing_branches(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return D.swing_branch(rows, F.col("o_orderstatus") == "O", lambda x: x.withColumn("o_totalprice", F.col("o_totalprice") * 2)).select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'text: required' WHEN length(text) < 100 THEN 'text: min:100' END AS error FROM documents WHERE text IS NULL OR trim(text) = '' OR length(text) < 100")
def validation_errors(spark, d):
    return D.validate(table(spark, d, "documents").select("doc_id", "text"), {"text": "required|min:100"}, quarantine=True)[1].select("doc_id", "error")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def first_records(spark, d):
    return D.truncate(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def positions(spark, d):
    return D.with_position(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "pos")


@query("SELECT packet, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS packet FROM orders) GROUP BY packet")
def packets(spark, d):
    rows = D.group(D.with_position(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]), 100)
    keys = F.transform("records", lambda r: r["o_orderkey"])
    return rows.select("packet", F.size("records").cast("bigint").alias("n"), F.array_min(keys).alias("first_key"), F.array_max(keys).alias("last_key"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def ungrouped_packets(spark, d):
    rows = D.with_position(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return D.ungroup(D.group(rows, 64)).select("o_orderkey", "o_custkey")


@query("SELECT geonameid, trim(unnest(string_split(alternatenames, ','))) AS value FROM geonames WHERE alternatenames IS NOT NULL")
def exploded_values(spark, d):
    rows = table(spark, d, "geonames").filter("alternatenames is not null").select("geonameid", F.split("alternatenames", ",").alias("value"))
    return D.exploding(rows).withColumn("value", F.trim("value"))


@query("SELECT l_orderkey AS id, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS value FROM lineitem GROUP BY l_orderkey")
def aggregated_values(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("value"), F.col("l_linenumber").alias("_pos"))
    return D.aggregate(rows).select("id", "value")


@query("SELECT l_suppkey AS id, round(sum(l_quantity), 3) AS value FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 1000")
def summed_over(spark, d):
    rows = D.summing(table(spark, d, "lineitem"), "l_suppkey", "l_quantity").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("value"))
    return D.greater(rows, 1000).withColumn("value", F.round("value", 3))


@query("SELECT n_name, unnest([1, 2]) AS source, n_regionkey AS target FROM nation")
def array_pairs(spark, d):
    rows = table(spark, d, "nation").select("n_name", F.array(F.lit(1), F.lit(2)).alias("a"), F.array("n_regionkey").alias("b"))
    return D.pair(rows, "a", "b").select("n_name", "source", "target")


@query("SELECT geonameid, list_transform(string_split(alternatenames, ','), lambda x: upper(trim(x))) AS names FROM geonames WHERE alternatenames IS NOT NULL")
def mapped_elements(spark, d):
    rows = table(spark, d, "geonames").filter("alternatenames is not null").select("geonameid", F.split("alternatenames", ",").alias("names"))
    return D.map_elements(rows, "names", lambda x: F.upper(F.trim(x)))


@query("SELECT mention_id, name, coalesce(length(name), -1) AS result FROM align_mentions")
def expanded_once_per_key(spark, d):
    rows = table(spark, d, "align_mentions").select("mention_id", "name")
    return D.expand(rows, "name", lambda k: k.select("key", F.length("key").alias("result")), default=None).withColumn("result", F.coalesce("result", F.lit(-1))).select("mention_id", "name", "result")


@query("SELECT c_custkey, coalesce(n_name, 'n/a') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def combined_values(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("value"))
    return D.combine(rows, names, "nation", default="n/a").select("c_custkey", "nation")


@query("SELECT p_partkey, reverse(p_name) AS value FROM part")
def executed_program(spark, d):
    def run(batches):
        for pdf in batches:
            yield pdf.assign(value=pdf["p_name"].str[::-1])[["p_partkey", "value"]]

    return D.execute(table(spark, d, "part").select("p_partkey", "p_name"), run, "p_partkey bigint, value string")


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS ids FROM customer")
def stamped_ids(spark, d):
    rows = D.identify(table(spark, d, "customer"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uri").alias("ids"))


@query("SELECT r_regionkey, r_name FROM region")
def packed_and_unpacked(spark, d):
    return D.unpack(D.pack(table(spark, d, "region").select("r_regionkey", "r_name")), "r_regionkey int, r_name string")


@query("SELECT count(DISTINCT c_name) AS n, count(DISTINCT c_name) AS keys, count(DISTINCT c_name) AS sound FROM customer")
def minted_keys(spark, d):
    done = D.generate_ark(table(spark, d, "customer"), "12345", "XYZ", "c_name")
    sound = F.col("ark").rlike("^ark:/12345/XYZ-[0-9b-z]{8}-[0-9b-z]$").cast("bigint")
    return done.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ark").alias("keys"), F.sum(sound).alias("sound"))


@query("SELECT DISTINCT profile_id, list_filter(coalesce(coAuthors, []), lambda x: x IS NOT NULL AND x <> '') AS names FROM author_profiles")
def compact_arrays(spark, d):
    return table(spark, d, "author_profiles").select("profile_id", A.compact(F.coalesce("coAuthors", F.array().cast("array<string>"))).alias("names")).distinct()


@query("""
SELECT geonameid, list_sort(list_distinct(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x))))) AS apart
FROM (SELECT geonameid, string_split(lower(name), ' ') AS a, string_split(lower(coalesce(alternatenames, '')), ' ') AS b FROM geonames)
""")
def symmetric_differences(spark, d):
    rows = table(spark, d, "geonames").select("geonameid", F.split(F.lower("name"), " ").alias("a"), F.split(F.lower(F.coalesce("alternatenames", F.lit(""))), " ").alias("b"))
    return rows.select("geonameid", F.array_sort(A.xor(F.col("a"), F.col("b"))).alias("apart"))


@query("SELECT geonameid, (string_split(name, ' '))[1] AS first, (string_split(name, ' '))[-1] AS last, CAST(len(string_split(name, ' ')) AS INT) AS n FROM geonames")
def ends_of_arrays(spark, d):
    words = F.split("name", " ")
    return table(spark, d, "geonames").select("geonameid", A.first_of(words).alias("first"), A.last_of(words).alias("last"), F.size(words).alias("n"))


@query("SELECT DISTINCT work_id, coalesce(author[1].family, 'n/a') AS lead, coalesce(author[2].given, 'n/a') AS second FROM crossref_works")
def nested_paths(spark, d):
    return table(spark, d, "crossref_works").select("work_id", A.get_path(F.col("author"), "0.family", "n/a").alias("lead"), A.get_path(F.col("author"), "1.given", "n/a").alias("second")).distinct()


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def maps_merged(spark, d):
    m = A.merge_maps(F.create_map(F.lit("name"), F.lit("?"), F.lit("region"), F.col("n_regionkey").cast("string")), F.create_map(F.lit("name"), F.col("n_name"), F.lit("x"), F.lit("y")))
    kept = A.omit_keys(m, "x")
    return table(spark, d, "nation").select("n_nationkey", kept["name"].alias("name"), A.pick_keys(kept, "region")["region"].cast("int").alias("region"))


@query("SELECT (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished")
def counted_metrics(spark, d):
    rows, seen = D.metrics(table(spark, d, "orders"), "orders", rows=F.count(F.lit(1)), finished=F.sum((F.col("o_orderstatus") == "F").cast("bigint")))
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["rows"], got["finished"])], "rows bigint, finished bigint")
