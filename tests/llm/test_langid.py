import numpy as np
import pytest

from corpusloom.llm.langid import Words, best_path, clean, detect_segments, fit_profiles, gram_vectors, language_cases

EN = "The narrow plasma reveals the early survey under the thermal surface and the network follows the protein. "
FR = "La cohorte révèle le champ optique sous la lumière et la nappe suit le bassin de la méthode. "
DE = "Die Messung bestimmt das schmale Gebirge unter der Küste und das Netzwerk zeigt die Schicht. "


@pytest.fixture(scope="module")
def profiles(spark, sf):
    return fit_profiles(spark.read.parquet(f"{sf}/detect_lang.parquet"))


def found(spark, profiles, *rows):
    df = spark.createDataFrame(rows, "id int, value string, lang string")
    return sorted((r["id"], r["seg"], r["lang"]) for r in language_cases(detect_segments(df, profiles)).collect())


def test_cases(spark, profiles):
    rows = [
        (1, EN, "en"), (2, EN, None), (3, FR, "English"), (4, FR, "français"), (5, EN + FR + DE, "en"), (6, EN + FR + EN, "mul"), (7, None, None), (8, "", "fr"), (9, "10.9/x.12 (37)", None), (10, FR + "(« the narrow plasma »)", "fr-FR"),
        (2, EN, None),
    ]
    assert found(spark, profiles, *rows) == [(2, 0, "en"), (3, 0, "fr"), (5, 0, "en"), (5, 1, "fr"), (5, 2, "de"), (6, 0, "en"), (6, 1, "fr"), (6, 2, "en")]


def test_long_text_and_empty_table(spark, profiles):
    assert found(spark, profiles, (1, EN * 2000 + DE * 2000, "en")) == [(1, 0, "en"), (1, 1, "de")]
    df = spark.createDataFrame([], "id int, value string, lang string")
    assert detect_segments(df, profiles).count() == 0


def test_labels_are_recovered(spark, sf, profiles):
    df = spark.read.parquet(f"{sf}/detect_lang.parquet")
    rows = [r for r in detect_segments(df, profiles).collect() if len(r["segs"]) == 1 and r["label"]]
    assert sum(r["label"] == r["segs"][0]["lang"] for r in rows) / len(rows) > 0.7  # some labels are wrong on purpose


def test_table_products_are_products_of_bundles():
    g = np.array([70000, 4242, 9001])
    v = gram_vectors(g, 512).astype(int)
    assert set(np.unique(v)) == {-1, 1} and abs((v[0] * v[1]).mean()) < 0.2


def test_best_path_against_brute_force():
    import itertools

    from corpusloom.llm.langid import SWITCH_AT_SENTENCE, SWITCH_INSIDE

    r = np.random.default_rng(0)
    for _ in range(20):
        n = int(r.integers(1, 6))
        s, first = (r.random((n, 3)) * 30).astype(np.float32), r.random(n) < 0.5
        cost = lambda p: sum(s[i, x] for i, x in enumerate(p)) - sum((SWITCH_AT_SENTENCE if first[i] else SWITCH_INSIDE) for i in range(1, n) if p[i] != p[i - 1])  # noqa: E731,B023
        best = max(itertools.product(range(3), repeat=n), key=cost)
        assert abs(cost(best) - cost(best_path(s, np.zeros(n, int), first, 1))) < 1e-3


def test_cleaning():
    assert "quoted" not in clean("a “quoted term” b") and "x-391" not in clean("der x-391 wert")
    assert Words(["", None, "a"]).n_texts == 3
