"""Sources, sinks and streams: whole tables written, read back or streamed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions.arrays import cast_array, is_empty
from corpusloom.functions.text import truncate_text
from corpusloom.operators.dataflow import Params, always, cached, debug, field_names, fork, pipeline, shift, singleton, ticket, transit
from corpusloom.plans.registry import query
from corpusloom.plans.routes import submit_route
from corpusloom.session import shared_dir, table
from corpusloom.sources import files as S
from corpusloom.streaming import streams as R
from corpusloom.streaming.jobs import Jobs


def _place(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files/{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_name IS NULL OR trim(c_name) = '' THEN 'n/a' ELSE c_name END AS value FROM customer")
def csv_wrapped(spark, d):
    path = _place(spark)
    S.write_csv(table(spark, d, "customer"), path)
    return S.wrap(S.read_csv(spark, path), "c_custkey", "c_name")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'n/a' ELSE text END AS value FROM documents")
def json_lines_wrapped(spark, d):
    path = _place(spark)
    table(spark, d, "documents").select("doc_id", "text").write.json(path)
    return S.wrap(S.read_json(spark, path, "doc_id bigint, text string", lines=True), "doc_id", "text")


@query("SELECT DISTINCT work_id, doi FROM crossref_works")
def xml_read_back(spark, d):
    path = _place(spark)
    table(spark, d, "crossref_works").select("work_id", "doi").distinct().write.format("xml").option("rowTag", "work").option("rootTag", "works").save(path)
    return S.read_xml(spark, path, "work", "work_id bigint, doi string")


@query("SELECT n_name AS value FROM nation")
def text_lines(spark, d):
    path = _place(spark)
    table(spark, d, "nation").select("n_name").write.text(path)
    return S.read_text(spark, path)


@query("SELECT s_suppkey, s_name FROM supplier")
def archive_round_trip(spark, d):
    path = _place(spark).removeprefix("file://").removeprefix("file:")
    S.write_corpus(table(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    return S.read_corpus(spark, path, "*/*.json").select(F.from_json(F.col("content").cast("string"), "s_suppkey bigint, s_name string").alias("r")).select("r.*")


@query("SELECT c_custkey AS \"id\", c_name AS \"who/name\", c_nationkey AS \"who/nation\" FROM customer")
def flattened_records(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("who"))
    return S.flatten(S.unflatten(S.flatten(rows)))


@query("SELECT l_orderkey AS id, l_partkey AS part, l_quantity AS quantity FROM lineitem")
def record_lines(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))).alias("value"))
    return S.lines_csv(rows)


@query("SELECT n_regionkey AS page, unnest(list_prepend('Page: ' || n_regionkey, list('\"' || n_name || '\"' ORDER BY n_name))) AS line FROM nation GROUP BY n_regionkey")
def page_tables(spark, d):
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("page")).agg(F.array_sort(F.collect_list("n_name")).alias("v")).select("page", F.transform("v", lambda x: F.create_map(F.lit("name"), x)).alias("json"))
    return S.page_lines(rows)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def streamed_windows(spark, d):
    rows = R.run_available(R.windowed_counts(R.stream_of(spark, d, "events"), "ts", "event_type", "value"), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def streamed_totals(spark, d):
    rows = R.run_available(R.running_totals(R.stream_of(spark, d, "events"), "user_id", "value"), "update")
    return rows.withColumn("total", F.round("total", 3))


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def streamed_once(spark, d):
    return R.run_available(R.first_seen(R.stream_of(spark, d, "events"), "event_id", "ts")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name AS name, 'r' || n_regionkey AS region, ['a', n_name] AS parts FROM nation")
def xml_paths(spark, d):
    xml = F.concat(F.lit('<t:doc xmlns:t="urn:x"><t:head id="r'), F.col("n_regionkey").cast("string"), F.lit('"><t:name>'), F.col("n_name"), F.lit("</t:name></t:head><t:p>a</t:p><t:p>"), F.col("n_name"), F.lit("</t:p></t:doc>"))
    return S.xml_fields(table(spark, d, "nation").select("n_nationkey", xml.alias("x")), "x", name="doc/head/name", region="doc/head/@id", parts="doc/p/text()")


@query("SELECT c_custkey, c_name FROM customer")
def json_array_read(spark, d):
    path = _place(spark)
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name"))).alias("value"))
    rows.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return S.read_json(spark, path, "c_custkey bigint, c_name string").select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def saved_and_loaded(spark, d):
    path = _place(spark)
    S.save(table(spark, d, "nation").select("n_nationkey", "n_name"), path, compress=True)
    S.save(table(spark, d, "region").toDF("n_nationkey", "n_name"), path, append=True, compress=True)
    return S.load(spark, path, "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name AS back, n_name AS listed FROM nation")
def text_sinks(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = nation.select("n_nationkey", S.xml_text(F.struct("n_name"), "nation").alias("x"))
    one = nation.groupBy("n_nationkey").agg(F.first("n_name").alias("n_name")).groupBy("n_nationkey").agg(S.json_array(nation.select("n_name"), True).alias("j"))
    back = S.xml_fields(rows, "x", back="nation/n_name")
    return back.join(one, "n_nationkey").select("n_nationkey", "back", F.from_json("j", "array<struct<n_name:string>>")[0]["n_name"].alias("listed"))


@query("SELECT 'f' || n_regionkey AS path, string_agg(n_name, '' ORDER BY n_nationkey) AS content FROM nation GROUP BY 1")
def merged_files(spark, d):
    pieces = table(spark, d, "nation").select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string"), F.lit("-"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").cast("binary").alias("content"))
    return S.merge_files(pieces).select("path", F.col("content").cast("string").alias("content"))


@query("SELECT 'query' AS id, 'all works' AS value UNION ALL SELECT CAST(work_id AS VARCHAR), CASE WHEN title IS NULL OR trim(title) = '' THEN 'n/a' ELSE title END FROM (SELECT DISTINCT work_id, title FROM crossref_works)")
def archive_wrapped(spark, d):
    docs = table(spark, d, "crossref_works").select("work_id", "title").distinct().select(F.to_json(F.struct(F.array(F.col("work_id").cast("string")).alias("ark"), F.col("title").alias("abstract"))).alias("content"))
    return S.wrap_query('{"query": {"q": "all works"}}', S.wrap_documents(docs, "ark array<string>, abstract string"))


@query("SELECT term, n FROM (SELECT unnest(string_split(p_name, ' ')) AS term, count(*) AS n FROM part GROUP BY 1) WHERE n >= 2".replace("SELECT unnest(string_split(p_name, ' ')) AS term, count(*) AS n FROM part GROUP BY 1", "SELECT term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part) GROUP BY 1"))
def routed_groups(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("value")).withColumn("id", F.monotonically_increasing_id())
    jobs = Jobs(spark, _place(spark))
    ticket = submit_route(jobs, "group-by", words)
    jobs.wait(ticket["value"])
    counts = jobs.result(ticket["value"]).filter("id = class_id").join(words, "id").select(F.col("value").alias("term"), (F.col("others") + 1).alias("n"))
    return counts.filter("n >= 2")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def cached_answers(spark, d):
    store, customers = _place(spark), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ask = lambda keys: keys.join(customers, "o_custkey")
    cached(orders.filter("o_custkey % 2 = 0"), "o_custkey", ask, store)
    return orders.join(cached(orders, "o_custkey", ask, store), "o_custkey").select("o_orderkey", "c_name")


@query("SELECT n_nationkey, TRUE AS value FROM nation")
def composed_statements(spark, d):
    seen: list[int] = []
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    steps = pipeline(transit, debug, lambda x: singleton(x, lambda first: seen.append(first.count()), "id"), lambda x: fork(x, lambda held: seen.append(held.count())), always)
    out = nation.transform(steps)
    assert seen[0] == 1 and seen[1] == nation.count() and shift(nation, "id").first()["id"] == 0
    return out.select(F.col("id").alias("n_nationkey"), "value")


@query("SELECT n_nationkey AS search, i AS number, 'r' || (n_nationkey * 100 + i) AS name FROM nation, (SELECT unnest(range(25)) AS i) WHERE i < n_nationkey")
def paged_searches(spark, d):
    def fetch(key, page):
        return [{"search": key, "number": i, "name": f"r{key * 100 + i}"} for i in range(page * 10, min(key, page * 10 + 10))]

    keys = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    return S.read_pages(keys, "k", fetch, 10, "search bigint, number bigint, name string")


@query("SELECT o_custkey, CASE WHEN o_custkey % 3 > 0 THEN 'name ' || o_custkey END AS name FROM orders GROUP BY 1")
def answers_in_batches(spark, d):
    ask = lambda keys: {k: {"name": f"name {k}"} for k in keys if k % 3}
    return S.ask_in_batches(table(spark, d, "orders"), "o_custkey", ask, 10, "name string")


@query("""
SELECT doc_id, text IS NULL OR trim(text, ' ') = '' AS empty, CASE WHEN title IS NULL THEN 0 ELSE 1 END AS listed, CASE WHEN length(text) <= 200 THEN text END AS whole, length(text) > 200 AS longer, 'run' AS name FROM documents
""")
def small_functions(spark, d):
    p = Params().with_(name="run")
    docs = table(spark, d, "documents")
    assert field_names(docs)[0] == "doc_id" and set(ticket("g")) == {"id", "value"}
    short = truncate_text(F.col("text"), 200)
    return docs.select(
        "doc_id", is_empty(F.col("text")).alias("empty"), F.size(cast_array(F.col("title"))).alias("listed"), F.when(F.length("text") <= 200, short).alias("whole"),
        ((F.length("text") > 200) & (F.length(short) <= 200)).alias("longer"), F.lit(p.get("name")).alias("name"),
    )
