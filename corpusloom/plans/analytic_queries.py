"""Aggregations and windows over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import sort_desc
from corpusloom.operators import analytics as A
from corpusloom.plans.registry import query
from corpusloom.session import table

_ITEMS = "SELECT l_orderkey AS id, CAST(l_suppkey AS VARCHAR) AS x, l_linenumber AS p FROM lineitem"


def _items(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("string").alias("x"), F.col("l_linenumber").alias("p"))


@query(f"""
WITH o AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY p, x) AS r FROM ({_ITEMS}))
SELECT a.x AS source, b.x AS target, count(*) AS weight, count(DISTINCT a.id) AS origins FROM o a JOIN o b ON a.id = b.id AND a.r < b.r GROUP BY 1, 2
""")
def graph_segment(spark, d):
    return A.cooccurrence(_items(spark, d), "id", "x", "p")


@query(f"""
SELECT source, target, count(*) AS weight, count(DISTINCT id) AS origins FROM (SELECT id, x AS source, lead(x) OVER (PARTITION BY id ORDER BY p, x) AS target FROM ({_ITEMS})) WHERE target IS NOT NULL GROUP BY 1, 2
""")
def tree_segment(spark, d):
    return A.transitions(_items(spark, d), "id", "x", ["p", "x"])


@query("""
SELECT source, target, count(*) AS weight, count(DISTINCT user_id) AS origins FROM (
  SELECT user_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL GROUP BY 1, 2
""")
def event_transitions(spark, d):
    return A.transitions(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("""
SELECT c_custkey, min(c_custkey) OVER w AS class_id, count(*) OVER w - 1 AS others FROM (SELECT c_custkey, c_mktsegment || c_nationkey AS v FROM customer) WINDOW w AS (PARTITION BY v)
""")
def group_by_value(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("v"))
    return A.same_value(rows, "c_custkey", "v")


@query("""
WITH w AS (SELECT count(DISTINCT p_size) AS population, count(p_size) AS count, sum(p_size)::DOUBLE AS sum, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, avg(p_size) AS mean, var_pop(p_size) AS variance, stddev_pop(p_size) AS deviation FROM part)
SELECT p_partkey, count(*) OVER (PARTITION BY p_size) AS sample, population, w.count, w.sum, w.min, w.max, round(mean, 6) AS mean, w.max - w.min AS range, (w.max + w.min) / 2 AS midrange, round(variance, 5) AS variance, round(deviation, 5) AS deviation,
  round((count(*) OVER (PARTITION BY p_size)) / population, 6) AS frequency FROM part, w
""")
def value_statistics(spark, d):
    out = A.statistics(table(spark, d, "part"), F.col("p_size"), ["p_partkey"]).drop("percentage")
    return out.withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 5), "deviation": F.round("deviation", 5), "frequency": F.round("frequency", 6)})


@query("SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY w HAVING count(*) >= 2")
def tag_cloud(spark, d):
    return A.frequent(table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")), "w")


@query("""
WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), t AS (SELECT count(DISTINCT l_suppkey) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM g, t WHERE n <= 0.2 * t)
""")
def spread_filtered(spark, d):
    return A.spread_filter(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", 0.2).select("l_orderkey", "l_linenumber", "l_partkey")


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS t FROM documents), tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM w)
SELECT t AS term, round(max(tf * (ln((1 + n) / (1.0 + df)) + 1)), 5) AS tfidf FROM tf JOIN df USING (t), n GROUP BY 1
""")
def highest_tf_idf(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("term"))
    return A.tf_idf(words, "doc_id", "term").groupBy("term").agg(F.round(F.max("tfidf"), 5).alias("tfidf"))


@query("""
SELECT l_orderkey, l_suppkey FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, min(l_linenumber), l_suppkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1
""")
def majority_values(spark, d):
    rows = table(spark, d, "lineitem").withColumn("at", F.struct("l_linenumber", "l_suppkey"))
    return A.majority(rows, "l_orderkey", "l_suppkey", "at")


@query("SELECT c_nationkey, c_custkey, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def best_per_group(spark, d):
    return A.top_k(table(spark, d, "customer"), "c_nationkey", [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


@query("""
WITH r AS (SELECT c_nationkey AS g, c_custkey AS k, c_acctbal AS s, row_number() OVER w AS r, c_acctbal - coalesce(lead(c_acctbal) OVER w, 0) AS gap FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC)),
l AS (SELECT g, min(r) AS last FROM (SELECT g, r, gap, max(round(gap, 9)) OVER (PARTITION BY g) AS m FROM r) WHERE round(gap, 9) = m GROUP BY g)
SELECT r.g AS c_nationkey, r.k AS c_custkey, CAST(r.r AS INT) AS rank FROM r JOIN l USING (g) WHERE r.r <= l.last
""")
def cut_at_largest_gap(spark, d):
    return A.cut_at_gap(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "rank")


@query("""
WITH c AS (SELECT l_suppkey AS item, count(*) AS n FROM lineitem GROUP BY 1)
SELECT item, n, round(sum(n) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS share FROM c
""")
def cumulative_shares(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return A.cumulative_share(counts, "item", "n").withColumn("share", F.round("share", 6))


@query(r"""
WITH c AS (SELECT w AS item, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM documents) GROUP BY 1),
l AS (SELECT n, count(*) AS m, sum(n * count(*)) OVER (ORDER BY n DESC) / sum(n * count(*)) OVER () AS share, sum(count(*)) OVER (ORDER BY n DESC) AS nodes FROM c GROUP BY n),
s AS (SELECT 0.20 + i * 0.025 AS try FROM (SELECT unnest(range(17)) AS i)),
t AS (SELECT try, min(nodes) AS nodes, max(n) AS threshold FROM s JOIN l ON share >= try - 1e-9 GROUP BY try),
e AS (SELECT nodes, threshold FROM t WHERE nodes >= 50 OR try >= 0.6 - 1e-9 ORDER BY try LIMIT 1), a AS (SELECT count(*) AS k FROM c)
SELECT CAST(CASE WHEN k < 100 THEN k ELSE nodes END AS BIGINT) AS nodes, CAST(CASE WHEN k < 100 THEN 1 ELSE threshold END AS BIGINT) AS threshold, CASE WHEN k < 100 OR threshold <= 1 THEN 0.0 ELSE greatest(1.0, threshold / 6) END AS edges FROM e, a
""")
def graph_thresholds(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return A.node_threshold(words, "item", "n").withColumn("edges", A.edge_threshold(F.col("threshold")))


@query("SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) AS c_mktsegment, list_sort(list_distinct(list(c_name))) AS targets FROM customer GROUP BY c_nationkey")
def merged_nodes(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", F.array("c_name").alias("targets"))
    return A.merge_nodes(rows, "c_nationkey", ["c_mktsegment"], "targets", "c_custkey")


_WORDS = "(SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part)"


@query(f"""
SELECT 'node' AS kind, w AS source, '' AS target, 1.5 * count(*) AS weight FROM {_WORDS} GROUP BY w
UNION ALL SELECT 'edge', least(a.w, b.w), greatest(a.w, b.w), count(*) FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY w) AS i FROM {_WORDS}) a JOIN (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY w) AS i FROM {_WORDS}) b ON a.p_partkey = b.p_partkey AND a.i < b.i GROUP BY 2, 3 HAVING count(*) >= 2
""")
def weighted_keywords(spark, d):
    nodes, edges = A.keyword_weights(table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("w")), "p_partkey", "w", 2)
    return nodes.select(F.lit("node").alias("kind"), F.col("node").alias("source"), F.lit("").alias("target"), "weight").unionAll(edges.select(F.lit("edge"), "source", "target", F.col("weight").cast("double")))


@query("""
WITH w AS (SELECT DISTINCT p_size % 4 AS topic, split_part(lower(p_name), ' ', 1) AS word FROM part), k AS (SELECT topic, word, 0.25 AS weight FROM w)
SELECT word AS node, sum(weight) AS weight, CAST(floor(sum(weight) * 1000) AS INT) AS size, CAST(min(topic) % 18 AS INT) AS colour, (SELECT count(DISTINCT b.word) FROM k a JOIN k b USING (topic) WHERE a.word = k.word AND b.word <> a.word) AS linked FROM k GROUP BY word
""")
def topic_word_graph(spark, d):
    words = table(spark, d, "part").select((F.col("p_size") % 4).alias("topic"), F.split(F.lower("p_name"), " ")[0].alias("word")).distinct().withColumn("weight", F.lit(0.25))
    nodes, edges = A.topic_graph(words)
    ends = edges.select(F.col("source").alias("node")).unionAll(edges.select("target")).groupBy("node").agg(F.count(F.lit(1)).alias("linked"))
    return nodes.join(ends, "node", "left").select("node", "weight", "size", "colour", F.coalesce("linked", F.lit(0)).alias("linked"))


@query("SELECT c_nationkey AS leader, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS INT) AS place FROM customer GROUP BY 1")
def groups_by_size(spark, d):
    return A.by_size(table(spark, d, "customer"), "c_nationkey")


@query("""
SELECT l_orderkey, list({'s': l_quantity, 'i': l_partkey, 't': l_shipmode} ORDER BY l_quantity DESC, l_partkey DESC, l_shipmode DESC) AS ranked FROM (SELECT l_orderkey, l_quantity, l_partkey, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1
""".replace("{'s': l_quantity, 'i': l_partkey, 't': l_shipmode}", "l_quantity || '/' || l_partkey || '/' || l_shipmode"))
def descending_neighbours(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_partkey", "l_linestatus")).alias("v"))
    return rows.select("l_orderkey", F.transform(sort_desc(F.col("v")), lambda x: F.concat_ws("/", x["l_quantity"], x["l_partkey"], x["l_linestatus"])).alias("ranked"))


_CITE = "SELECT DISTINCT ref_id, citing_doi AS s, lower(nullif(regexp_extract(raw_ref, '(?i)\\b(10\\.\\d{4,9}/[^\\s\"<>]+?)[.,;)\\]]*(?:\\s|$)', 1), '')) AS t FROM bibrefs"


@query(f"SELECT s AS source, t AS target, count(*) AS weight FROM ({_CITE}) WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2")
def citation_links(spark, d):
    from corpusloom.functions.text import find_doi

    refs = table(spark, d, "bibrefs").select("ref_id", F.col("citing_doi").alias("s"), find_doi(F.col("raw_ref")).alias("t")).distinct()
    return A.citation_edges(refs, "s", "t")[0]


@query(f"""
WITH e AS (SELECT s, t, count(*) AS w FROM ({_CITE}) WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2), n AS (SELECT s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e)
SELECT node, CAST(sum(i) AS BIGINT) AS count, CASE WHEN max(o) = 1 AND max(i) = 1 THEN 'both' WHEN max(i) = 1 THEN 'cited' ELSE 'citing' END AS status, round(log10(sum(i) + 1) * 50 + 50, 6) AS size FROM n GROUP BY node
""")
def citation_nodes(spark, d):
    from corpusloom.functions.text import find_doi

    refs = table(spark, d, "bibrefs").select("ref_id", F.col("citing_doi").alias("s"), find_doi(F.col("raw_ref")).alias("t")).distinct()
    return A.citation_edges(refs, "s", "t")[1].withColumn("size", F.round("size", 6))


@query("""
SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (
  SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1
""")
def user_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w)))
    e = e.withColumn("s", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 1_800_000_000), 1).otherwise(0)).over(w))
    return e.groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("""
SELECT coalesce(c_mktsegment, 'ALL') AS segment, coalesce(CAST(c_nationkey AS VARCHAR), 'ALL') AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)
""")
def cube_of_customers(spark, d):
    rows = table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return rows.select(F.coalesce("c_mktsegment", F.lit("ALL")).alias("segment"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("ALL")).alias("nation"), "n", "balance")


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def revenue_by_nation(spark, d):
    l, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
