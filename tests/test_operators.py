"""Operators on small cases, published examples among them."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import analytics as A
from corpusloom.operators import dataflow as D
from corpusloom.operators import joins as J
from corpusloom.operators import learning as L
from corpusloom.operators import references as R
from corpusloom.operators import similarity as S
from corpusloom.operators import terms as X
from corpusloom.operators.graph import components
from corpusloom.sources import files as S_files
from corpusloom.streaming.jobs import Jobs, with_retries

KEYWORDS = [("#1", "abc"), ("#2", "acd"), ("#3", "abd"), ("#4", "abcd"), ("#5", "acde")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, p, x) for i, v in KEYWORDS for p, x in enumerate(v)], "id string, p int, x string")


def test_cooccurrence_example(items):
    got = {f"{r.source}-{r.target}": r.weight for r in A.cooccurrence(items, "id", "x", "p").collect()}
    assert got == {"a-b": 3, "a-c": 4, "b-c": 2, "a-d": 4, "c-d": 3, "b-d": 2, "a-e": 1, "c-e": 1, "d-e": 1}


def test_transitions_example(items):
    got = {f"{r.source}-{r.target}": r.weight for r in A.transitions(items, "id", "x", ["p"]).collect()}
    assert got == {"a-b": 3, "b-c": 2, "a-c": 2, "c-d": 3, "b-d": 1, "d-e": 1}


def test_group_and_statistics_example(spark):
    rows = spark.createDataFrame([("#1", "a"), ("#2", "b"), ("#3", "c"), ("#4", "a"), ("#5", "b")], "id string, v string")
    got = {r["id"]: (r["class_id"], r["others"]) for r in A.same_value(rows, "id", "v").collect()}
    assert got == {"#1": ("#1", 1), "#4": ("#1", 1), "#2": ("#2", 1), "#5": ("#2", 1), "#3": ("#3", 0)}
    stats = {r["id"]: r for r in A.statistics(rows, F.col("v"), ["id"]).collect()}
    assert [stats[f"#{k}"]["sample"] for k in range(1, 6)] == [2, 2, 1, 2, 2]
    assert stats["#1"]["population"] == 3 and stats["#1"]["count"] == 5 and stats["#1"]["sum"] == 0 and stats["#1"]["percentage"] is None


def test_null_values_make_a_class(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, v string")
    assert {r["id"]: r["class_id"] for r in A.same_value(rows, "id", "v").collect()} == {1: 1, 2: 1, 3: 3}


def test_validation(spark):
    rows = spark.createDataFrame([("a",), (None,), (" ",)], "v string")
    good, bad = D.validate(rows, {"v": "required|min:1"}, quarantine=True)
    assert good.count() == 1 and {r["error"] for r in bad.collect()} == {"v: required"}
    with pytest.raises(Exception, match="v: required"):
        D.validate(rows, {"v": "required"}).collect()


def test_positions_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = sorted((r["k"], r["_pos"]) for r in D.with_position(rows, ["k"]).collect())
    assert got == [(k, k) for k in range(1000)]


def test_keys_are_minted_once(spark):
    rows = spark.range(500).select(F.concat(F.lit("v"), "id").alias("v"))
    first = D.generate_ark(rows, "12345", "AB", "v")
    again = D.generate_ark(rows.unionAll(spark.createDataFrame([("new",)], "v string")), "12345", "AB", "v", registry=first)
    assert first.select("ark").distinct().count() == 500
    assert [r["v"] for r in again.collect()] == ["new"]


def test_throttle_and_batches():
    assert list(D.throttle([1, 2, 3], 1e6)) == [1, 2, 3]
    assert list(J.batched(iter(range(5)), 2)) == [[0, 1], [2, 3], [4]]
    calls = []
    assert with_retries(lambda: calls.append(1) or (1 / (len(calls) - 1)), pause=0.0) == 1.0


def test_components_join_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a int, b int")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {got[k] for k in range(61)} == {0} and got[101] == 100
    assert components(edges.limit(0)).count() == 0


def test_longest_match_wins(spark):
    texts = spark.createDataFrame([(1, "Deep neural network here")], "id int, t string")
    terms = spark.createDataFrame([("neural",), ("neural network",)], "term string")
    got = J.longest_match(J.contained_terms(texts, terms, "id", "t", "term"), "id").collect()
    assert [(r["term"], r["at"]) for r in got] == [("neural network", 1)]


def test_resolver_misses(spark):
    labels = spark.createDataFrame([("Pérou", "u1")], "label string, uri string")
    concepts = spark.createDataFrame([("u1", "Peru")], "uri string, label string")
    got = {r["v"]: r["concept"] for r in J.resolve(spark.createDataFrame([("perou",), ("toto",)], "v string"), labels, concepts, "v").collect()}
    assert got == {"perou": "Peru", "toto": "n/a"}


def test_reference_states(spark):
    works = spark.createDataFrame([("10.1/a", "Deep things in small boxes", "Smith", 2001, "Boxes"), ("10.1/b", "Bad", "Roe", 2002, "X")], "doi string, title string, author string, year int, source string")
    refs = spark.createDataFrame(
        [(1, "Smith (2001) Deep things in small boxes. Boxes. 10.1234/none"), (2, None), (3, "no identifier"), (4, "10.1/a"), (5, "Someone else (1990) Entirely other matter of quite some length. 10.1/a"), (6, "10.1/b")], "id int, t string"
    )
    works = works.withColumn("doi", F.replace("doi", F.lit("10.1/"), F.lit("10.1000/")))
    refs = refs.withColumn("t", F.replace("t", F.lit("10.1/"), F.lit("10.1000/")))
    got = {r["id"]: r["status"] for r in R.validate_references(refs, works, works.filter("title = 'Bad'").select("doi"), "id", "t").collect()}
    assert got == {1: "found", 2: "error_data", 3: "not_found", 4: "found", 5: "to_be_verified", 6: "retracted"}


def test_species_short_forms(spark):
    texts = spark.createDataFrame([(1, "Homo sapiens met H. sapiens and P. major."), (2, "H. sapiens alone.")], "id int, t string")
    names = spark.createDataFrame([("Homo sapiens",), ("Parus major",)], "name string")
    assert {(r["id"], r["name"]) for r in X.species_names(texts, names, "id", "t").collect()} == {(1, "Homo sapiens")}


def test_spans(spark):
    rows = spark.createDataFrame([(["A", "B", "x", "C"], ["B-P", "I-P", "O", "B-P"], [0.9, 0.7, 1.0, 0.4])], "w array<string>, t array<string>, s array<double>")
    got = rows.select(X.labelled_spans(rows, "w", "t", "s", 0.7).alias("r")).collect()[0]["r"]
    assert [(x["text"], x["tag"]) for x in got] == [("A B", "P")]


def test_like_vectors_against_brute_force(spark, sf):
    import numpy as np

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    pdf = e.toPandas()
    x = np.stack(pdf["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    ids = pdf["vec_id"].to_numpy()
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.where(np.triu(c, 1) >= 0.8))}
    got = {(r["a"], r["b"]) for r in S.similar_vectors(e, "vec_id", "embedding", 0.8).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_all_like_vectors_are_found(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = r.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((400, 32))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    v = np.concatenate([x, 0.71 * x + (1 - 0.71**2) ** 0.5 * y])
    c = v @ v.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(c, 1) >= 0.7))}
    e = spark.createDataFrame([(i, [float(z) for z in v[i] * (1 + i)]) for i in range(len(v))] + [(9000, None), (9001, []), (0, [float(z) for z in v[0]])], "id int, v array<double>")
    for most in (1 << 26, 40_000):
        got = {(p["a"], p["b"]): p["cosine"] for p in S.similar_vectors(e, "id", "v", 0.7, most).collect()}
        assert set(got) == want and len(want) >= 400
        assert all(abs(got[p] - c[p]) < 1e-9 for p in want)
    assert S.similar_vectors(e.limit(0), "id", "v").count() == 0


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 1)]
    got = {r["node"]: r["community"] for r in L.communities(spark.createDataFrame(edges, "source string, target string, weight int")).collect()}
    assert len({got[x] for x in "abcd"}) == 1 and len({got[x] for x in "wxyz"}) == 1 and got["a"] != got["z"]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", "", [1, 2]), ("2", "Not empty", [])], "id string, content string, n array<int>")
    S_files.write_csv(rows, str(tmp_path / "csv"))
    back = S_files.read_csv(spark, str(tmp_path / "csv"))
    assert {(r["id"], r["value"]) for r in S_files.wrap(back, "id", "content").collect()} == {("1", "n/a"), ("2", "Not empty")}
    assert {r["n"] for r in back.collect()} == {"[1,2]", "[]"}
    S_files.write_corpus(rows.select("id"), str(tmp_path / "tar"))
    assert json.loads((tmp_path / "tar" / "manifest.json").read_text())["count"] == 2
    assert S_files.read_corpus(spark, str(tmp_path / "tar"), "data/*.{json,txt}").count() == 2
    assert 'source="a&amp;b"' in S_files.gexf([{"id": "a&b"}], [{"source": "a&b", "target": "c"}])


def test_jobs_keep_the_first_error(spark, tmp_path):
    jobs = Jobs(spark, str(tmp_path))
    good, bad = jobs.submit("ok", lambda: spark.range(3)), jobs.submit("bad", lambda: spark.sql("select * from no_such_table"))
    assert jobs.wait(good["value"]) == "done" and jobs.result(good["value"]).count() == 3
    assert jobs.wait(bad["value"]) == "error" and "no_such_table" in jobs.status(bad["value"])["message"]


def test_number_of_topics_is_in_range(spark):
    texts = [("stone river mountain valley forest",), ("plasma signal sensor network model",)] * 20
    assert 2 <= L.choose_topics(spark.createDataFrame(texts, "t string"), "t", high=4, step=2, iterations=2) <= 4


def test_cut_tables_can_be_released(spark):
    from corpusloom.session import cut, once, release

    rows = cut(spark.range(10).withColumn("k", F.col("id") % 3))
    assert once(rows, "k").count() == 3
    assert release(spark) >= 1 and release(spark) == 0


def test_keyword_neighbours_reads_whole_texts(spark, tmp_path):
    from corpusloom.plans import learning_queries  # noqa: F401
    from corpusloom.plans.registry import queries

    fill = " ".join(f"filler{'abcdefghij'[k % 10]}" for k in range(1100))
    rows = [(1, f"{fill} {'protein receptor ' * 300}"), (2, f"{fill} {'protein receptor ' * 300}"), (3, "protein " * 10), (4, "stone river")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert "receptor" in {r["term"] for r in queries()["keyword_neighbours"](spark, str(tmp_path)).collect()}


def test_keywords_are_trained_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_WORDS", 100)
    rows = [(k, ["protein", "receptor", f"w{k % 7}"] * (1 + k % 3)) for k in range(60)] + [(99, [])]
    words = spark.createDataFrame(rows, "doc_id int, words array<string>")
    model, weight = L.keyword_vectors(words, "doc_id", "words", size=8, iterations=1)
    assert model.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism)
    want = A.tf_idf(words.select("doc_id", F.explode("words").alias("term")), "doc_id", "term").groupBy("term").agg(F.max("tfidf").alias("x"))
    assert {r["term"]: r["tfidf"] for r in weight.collect()} == {r["term"]: r["x"] for r in want.collect()}
