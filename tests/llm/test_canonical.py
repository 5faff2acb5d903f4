import random

import numpy as np
import pandas as pd

from corpusloom.llm.canonical import Aligner, BKTree, Reader, align_values, group_names, list_entries
from corpusloom.llm.text import Patterns, Signs, banded, distances, plain, with_swaps


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(n, seed, size=(0, 14), signs="abcd e"):
    r = random.Random(seed)
    return ["".join(r.choice(signs) for _ in range(r.randint(*size))) for _ in range(n)]


def test_distances():
    many = "".join(map(chr, range(0x4E00, 0x4E80)))
    for signs in ("abcd e", "москваπάε", "aб漢字0", many):
        a, b = words(200, 1, signs=signs), words(200, 2, signs=signs[:9])
        packed = Patterns(a + b, Signs())
        got = distances(packed, np.arange(200), packed.codes, packed.size, np.arange(200, 400))
        for x, y, d in zip(a, b, got):
            want = plain_distance(x, y)
            assert d == want
            assert banded(x, y, 3) == min(want, 4)
    assert with_swaps("abcd", "abdc") == 1 and with_swaps("", "ab") == 2


def test_other_scripts_stay_apart():
    tree = BKTree(["москва", "paris", "東京都庁"])
    assert tree.search(["лондон", "москвы", "北京市役"], [0, 1, 2]) == [[], [("москва", 1)], []]


def test_tree_returns_every_entry_within_the_radius():
    keys = sorted({w for w in words(400, 3, (1, 12))} | {"x" * 80})
    tree = BKTree(keys)
    queries = words(60, 4, (1, 12)) + ["x" * 79]
    for q, found in zip(queries, tree.search(queries, [2] * len(queries))):
        assert sorted(found) == sorted((k, plain_distance(q, k)) for k in keys if plain_distance(q, k) <= 2)
    assert BKTree([]).search(["a"], [2]) == [[]]


def places(spark):
    rows = [(1, "Newtown upon Sea", "Newtown upon Sea", "Nova Villa,Newtownstadt", "AA", 10), (2, "Sankt Orlof", "Sankt Orlof", None, "AA", 5), (3, "Sankt Orlof", "Sankt Orlof", None, "BB", 50), (4, "Bréval", "Breval", None, "BB", 0)]
    df = spark.createDataFrame(rows, "geonameid bigint, name string, asciiname string, alternatenames string, country_code string, population bigint")
    return list_entries(df, "geonameid", ["name", "asciiname"], "alternatenames", "country_code", "population")


GROUPS = {"aland": "AA", "aa": "AA", "aaa": "AA", "republic of beeland": "BB", "bb": "BB", "beeland": "BB"}
CASES = [
    ("Newtown upon Sea", None, None, 1), ("NEWTOWN UPON SEA city", None, None, 1), ("12345 Newtwon upon Sea", None, None, 1), ("Nova Villa, AA", None, None, 1), ("near Nova Vila", None, None, 1),
    ("St. Orlof", None, None, 3), ("St. Orlof", "aa", None, 2), ("Sankt Orlof (Aland)", None, None, 2), ("Sankt Orlof", None, "samples from Sankt Orlof in Aland", 2), ("Sankt Orlof", "ZZ", None, 3),
    ("Breval Cedex 3", None, None, 4), ("Breval", "AA", None, -1), ("Elsewhere", None, None, -1), ("zone 54", None, None, -1), ("?", None, None, -1), ("Newtown upon Sea " * 300, None, None, -1),
]


def test_alignment(spark):
    rows = [(k, *c[:3], "clash") for k, c in enumerate(CASES)] + [(0, *CASES[0][:3], "clash"), (98, None, None, None, "clash"), (99, " \t", None, None, "clash")]
    df = spark.createDataFrame(rows, "mention_id bigint, name string, country_code string, context string, entry string")
    for bound in (1000, 2):  # broadcast, then in shards
        got = {r["mention_id"]: r["entry"] for r in align_values(df, places(spark), GROUPS, most_broadcast=bound).collect()}
        assert got == {k: c[3] for k, c in enumerate(CASES)}


def test_shards_keep_the_rank_of_a_spelling(spark):
    entries = spark.createDataFrame([("newtown lake", 2, "AA", 0.0), ("newtown", 1, "AA", 9.0), ("nolt", 3, "AA", 1.0)], "key string, entry bigint, grp string, weight double")
    df = spark.createDataFrame([(1, "Newtown, Lake"), (2, "nlot"), (3, "nilt"), (4, "nilo")], "mention_id bigint, name string")
    for bound in (1000, 2, 1):
        got = align_values(df, entries, {}, group_col=None, context_col=None, most_broadcast=bound)
        assert {r["mention_id"]: r["entry"] for r in got.collect()} == {1: 2, 2: 3, 3: 3, 4: -1}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a place", None, None)], "mention_id bigint, name string, country_code string, context string")
    assert align_values(df.limit(0), places(spark), GROUPS).count() == 0
    assert [r["entry"] for r in align_values(df, places(spark).limit(0), {}).collect()] == [-1]
    assert group_names(spark.createDataFrame([("AA", "A Land")], "c string, n string"), "c", ["n"]) == {"aa": "AA", "a land": "AA"}


def test_reader_and_ties():
    r = Reader(GROUPS)
    assert r.read("city of Newtown, Aland")[0][0] == "newtown" and r.read("Newtown AAA")[1] == "AA"
    e = pd.DataFrame({"key": ["alpha", "alpha"], "entry": [7, 3], "grp": ["AA", "BB"], "weight": [1.0, 1.0]})
    assert Aligner(e, r).align([("Alpha", None, None)])[0][0] == 3
    assert plain("  Grüße—42 ") == "grusse 42"
