import pytest

from corpusloom.llm.mixing import Node, build_tree, feasible_total, mix_sources, share_out


def test_shortages_go_to_siblings_first():
    a = Node("a", 0.5, 100, children={"x": Node("x", 1, 10), "y": Node("y", 1, 90)})
    b = Node("b", 0.5, 1000, children={"z": Node("z", 1, 1000)})
    share_out(160, [a, b])
    assert a.budget == b.budget == 80
    assert a.children["x"].budget == 10 and a.children["y"].budget == 70
    share_out(400, [a, b])  # a cannot take its half: the rest goes to its sibling
    assert a.budget == 100 and b.budget == 300


def test_feasible_total():
    root = build_tree([(("s",), 100.0, 2), (("t",), 50.0, 1)], {"s": 0.5, "t": 0.25, "empty": 0.25})
    assert feasible_total(root) == pytest.approx(150)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, "some words of a text " * (1 + k % 3), "big", "en") for k in range(300)] + [(1000 + k, "few words here", "small", "fr") for k in range(10)] + [(2000, None, "big", "en"), (2001, "", "small", "en"), (2002, "alone", None, "en"), (2003, "other", "unlisted", None)]
    return spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, source string, lang string")


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark, docs):
    got, report = mix_sources(docs, targets(spark, ("big", 0.8, 1), ("small", 0.2, 4), ("none", 0.1, 3)), levels=("source", "lang"))
    shares = {r["source"]: r for r in report.collect()}
    assert abs(shares["big"]["actual_share"] - 0.8 / 1.0) < 0.02 and abs(shares["small"]["actual_share"] - 0.2) < 0.02
    assert shares["none"]["taken_tokens"] == 0 and shares["none"]["actual_share"] == 0
    rows = got.collect()
    assert max(r["times"] for r in rows if r["source"] == "small") <= 4 and max(r["times"] for r in rows if r["source"] == "big") <= 1
    assert {r["source"] for r in rows} == {"big", "small"} and len({r["doc_id"] for r in rows}) == len(rows)


def test_a_total_beyond_what_is_there(spark, docs):
    got, report = mix_sources(docs, targets(spark, ("big", 0.5, 2), ("small", 0.5, 3)), total=10**9)
    r = {x["source"]: x for x in report.collect()}
    assert r["big"]["taken_tokens"] == 2 * r["big"]["available_tokens"] and r["small"]["taken_tokens"] == 3 * r["small"]["available_tokens"]


def test_same_seed_same_mix(spark, docs):
    t = targets(spark, ("big", 0.9, 1), ("small", 0.1, 2))
    pick = lambda seed: sorted((x["doc_id"], x["times"]) for x in mix_sources(docs, t, total=500, seed=seed)[0].collect())
    assert pick(1) == pick(1) != pick(2)


def test_empty(spark, docs):
    got, report = mix_sources(docs.limit(0), targets(spark, ("big", 1.0, 1)))
    assert got.count() == 0 and report.collect()[0]["actual_share"] == 0
    assert mix_sources(docs, targets(spark).limit(0))[0].count() == 0


def test_shortages_stay_in_their_domain():
    leaves = [(("web", "a", "en"), 10.0, 1), (("web", "b", "en"), 100.0, 1), (("web", "b", "fr"), 100.0, 1), (("books", "c", "en"), 1000.0, 1)]
    root = build_tree(leaves, {"a": 0.25, "b": 0.25, "c": 0.5, "none": 0.1}, 1)
    assert feasible_total(root, 1) == pytest.approx(40)
    share_out(200, list(root.children.values()))
    web = root.children["web"]
    assert web.budget == pytest.approx(100) and web.children["a"].budget == 10 and web.children["b"].budget == pytest.approx(90) and web.children["b"].children["fr"].budget == pytest.approx(45)
    share_out(600, list(root.children.values()))  # the web cannot take its half: the rest goes to the other domain
    assert root.children["web"].budget == 210 and root.children["books"].budget == pytest.approx(390)


def test_domains_and_missing_repeats(spark):
    df = spark.createDataFrame([(k, "word " * 20, "s" if k < 2 else "t", "d") for k in range(10)], "doc_id bigint, text string, source string, domain string")
    targets = spark.createDataFrame([("s", 0.5, None), ("t", 0.5, 1)], "source string, target_share double, max_repeats int")
    docs, report = mix_sources(df, targets, levels=("domain", "source"), of="source", total=160)
    got = {r["source"]: (r["taken_tokens"], r["actual_share"]) for r in report.collect()}
    assert got["s"][0] == got["t"][0] / 3 or got["s"][0] < got["t"][0] and docs.groupBy("doc_id").count().filter("count > 1").count() == 0
