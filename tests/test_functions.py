"""Column functions on small cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import text as T


def one(spark, value, f, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (T.normalize_term, "Côte d'Ivoire", "COTE D IVOIRE"),
        (T.normalize_term, "Café !", "CAFE"),
        (T.deburr, "Œuvre Łódź ßtraße Ångström é", "OEuvre Lodz sstrasse Angstrom e"),
        (T.label_key, "Grand-Duché de Luxembourg", "grandduchedeluxembourg"),
        (T.uniformize, "  L'été — 42!", "l ete 42"),
        (T.normalize_affiliation, "Université de Paris, Centre X, France", "univ de paris ctr x"),
        (T.find_doi, "See https://doi.org/10.1000/ABC.123. Next", "10.1000/abc.123"),
        (T.find_doi, "arXiv:2101.12345", "10.48550/arxiv.2101.12345"),
        (T.find_doi, "none", None),
        (T.doi_prefix, "https://doi.org/10.1038/x", "10.1038"),
        (T.find_year, "vol 12345 in 1998", 1998),
        (T.find_year, "none", None),
        (T.clean_title, "RETRACTED ARTICLE: A <i>b</i>", "A b"),
        (T.find_units, "UMR 7118 and umr7118, UAR 12", ["umr7118", "uar12"]),
        (T.first_token_kind, "EDF, Paris", "private"),
        (T.first_token_kind, "UMR 5205 (CNRS), Lyon", "public"),
        (T.first_token_kind, "Univ. Lorraine SARL", "public"),
        (T.first_token_kind, "nobody", "n/a"),
        (T.cyrillic_to_latin, "Москва XIX", "Moskva XIX"),
        (T.greek_share, "αβ cd", 0.5),
        (T.greek_share, "  ", None),
        (T.french_tokens, "L'été, qu'il", ["L'", "été", ",", "qu'", "il"]),
        (T.sentences, "One. Two! three. 4 five", ["One.", "Two! three.", "4 five"]),
        (T.singularize, "studies", "study"),
        (T.humanize, "deep networks!", "Deep network"),
        (T.page_count, "19-12", 8),
        (T.page_count, "7", 1),
        (T.page_count, "x", None),
        (T.keyword_fields, 'keywords:"a b" AND keywords.raw:c', ["a b", "c"]),
        (T.line_filter, "Good line\nhttp://x.org y\n#$%&/()\nWith [3] mark\nReferences\nlost", ["Good line", "With  mark"]),
    ],
)
def test_text_function(spark, f, value, want):
    assert one(spark, value, f) == want
    assert one(spark, None, f) in (None, "n/a", [])


def test_ratios_follow_the_published_example(spark):
    a = "IESM - International Conference on Industrial Engineering and Systems Management"
    b = "Intrenational Conference on Industrial Engineering and Systems Management"
    r = spark.createDataFrame([(a, b)], "a string, b string").select(T.ratio(F.col("a"), F.col("b")).alias("r"), T.partial_ratio(F.col("a"), F.lit("Industrial Engineering")).alias("p")).collect()[0]
    assert 0.9 < r["r"] < 1 and r["p"] == 1.0


def test_abbreviations_take_as_many_words_as_letters(spark):
    got = one(spark, "A Convolutional neural network (CNN) and (2019) text", T.abbreviations)
    assert [(x["short"], x["long"]) for x in got] == [("CNN", "Convolutional neural network")]


def test_quantities(spark):
    got = one(spark, "about 12.5 kg at 20 °C, model X-300", T.quantities)
    assert [(q["quantity"], q["unit"], q["kind"]) for q in got] == [("12.5", "kg", "mass"), ("20", "°C", "temperature")]


def test_variants_and_expansion(spark):
    df = spark.createDataFrame([("Ada", "Lovelace")], "f string, l string")
    assert df.select(T.name_variants(F.col("f"), F.col("l")).alias("v")).collect()[0]["v"][:3] == ["Ada Lovelace", "Lovelace Ada", "Lovelace, Ada"]
    assert one(spark, "Univ. of X, Lab. Y", lambda c: T.expand_tokens(c, {"univ": "University", "lab": "Laboratory"})) == "University of X, Laboratory Y"


def test_arrays(spark):
    v = ["a", "", None, "b", "a"]
    assert one(spark, v, A.compact, "v array<string>") == ["a", "b", "a"]
    assert one(spark, v, A.uniq, "v array<string>") == ["a", "", None, "b"]
    assert one(spark, ["a", "b", "c"], lambda c: A.xor(c, F.array(F.lit("b"), F.lit("d"))), "v array<string>") == ["a", "c", "d"]
    assert [tuple(x) for x in one(spark, ["a", "b", "c"], A.pairs_of, "v array<string>")] == [("a", "b"), ("a", "c"), ("b", "c")]
    assert [tuple(x) for x in one(spark, ["a", "b", "c"], A.sliding_pairs, "v array<string>")] == [("a", "b"), ("b", "c")]
    assert one(spark, ["a"], A.pairs_of, "v array<string>") == []
    assert one(spark, [], A.sliding_pairs, "v array<string>") == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_digits_come_back(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    back = rows.select("v", T.decode_digits(T.encode_digits(F.col("v"), "qx", "xq"), "qx", "xq").alias("b")).collect()
    assert all(r["v"] == r["b"] for r in back if "qx" not in r["v"] and "xq" not in r["v"])
