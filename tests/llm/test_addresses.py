import random

import numpy as np

from corpusloom.llm.addresses import SURE, AddressReader, link_sites, name_keys, same_name, site_pairs
from corpusloom.llm.ngrams import cosine, gram_weights, index_keys, prefix, similar_pairs, weighted

TOWNS = {"belmora": "belmora", "sankt orlof": "sankt orlof", "castel vire": "castel vire"}
COUNTRIES = {"valdria": "VD", "vd": "VD", "vdr": "VD", "ostland": "OL", "ol": "OL"}


def test_reader():
    r = AddressReader(set(TOWNS), COUNTRIES)
    for text in (
        "Institut Zorvan de Biologie, 12 rue de Plimor, 01234 Belmora, Valdria", "VALDRIA; V-01234 BELMORA CEDEX 3; 12, r. Plimor; INST. ZORVAN DE BIOLOGIE", "Département de Chimie, Institut Zorvan de Biologie, B.P. 77, rue Plimor, n° 12, Belmora, VD",
        "A. Person (reprint author), Inst. Zorvan de Biologie\n12 rue Plimor\nBelmora",
    ):
        a = r.read(text)
        assert (a.org, a.street, a.number, a.town) == ("zorvan", "plimor", "12", "belmora"), text
    a = r.read("Zorvan-Institut für Biologie, Plimorstr. 7, Sankt Orlof")
    assert (a.org, a.street, a.number, a.town) == ("zorvan", "plimor", "7", "sankt orlof")
    assert r.read("Zorvan Institute of Biology, 7 Plimor La., Belmora").street == "plimor"
    assert r.read("IZB, 12 rue Plimor, Belmora").acronym == "izb" and r.read(None).org == r.read("-").org == ""


ROWS = [
    (1, "Institut Zorvan de Biologie, 12 rue Plimor, 01234 Belmora, Valdria"), (2, "12, r. Plimor; BELMORA; Inst. Zorvna de Biologie"), (3, "Institut Zorvan de Biologie, Belmora"), (4, "IZB [Belmora]"),
    (5, "Institut Zorvan de Biologie, 14 rue Plimor, 01239 Belmora"), (6, "Institut Zorvan de Biologie, Castel Vire"), (7, "12 rue Plimor, Belmora"), (8, None), (9, ""), (10, "n/a"), (11, "12 rue Plimor, Castel Vire"), (1, "Institut Zorvan de Biologie, 12 rue Plimor, 01234 Belmora, Valdria"),
]


def test_sites(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "id bigint, value string, site string")
    got = {(r["id_a"], r["id_b"]) for r in site_pairs(link_sites(df, TOWNS, COUNTRIES)).collect()}
    one = [1, 2, 3, 4, 7]
    assert got == {(a, b) for a in one for b in one if a < b}
    assert link_sites(df.limit(0), TOWNS, COUNTRIES).count() == 0


def test_names():
    assert same_name("plimorstr", "plimor") and same_name("zorvan", "zorvna") and not same_name("zorvan", "plimor") and not same_name("abc", "abde")
    assert same_name("kodackpri", "kodackpriwge") and same_name("focauflart", "focauflart raod") and same_name("maibrain", "maibrain cjm")
    assert not same_name("martin", "martin luther") and not same_name("charles", "charles bert") and not same_name("weton", "wetonshire")


def test_similarity_join_against_brute_force(spark):
    r = random.Random(7)
    strings = sorted({"".join(r.choice("abcdef") for _ in range(r.randint(3, 9))) for _ in range(150)} | {"abcdefabc", "abcdefabd"})
    df = spark.createDataFrame([("k", s) for s in strings] + [("other", "abcdefabc"), (None, "abcdefabc"), ("k", None)], "block string, s string")
    w = gram_weights(df.filter("block is not null and s is not null"))
    v = {s: weighted(s, w) for s in strings}
    want = {(a, b) for i, a in enumerate(strings) for b in strings[i + 1 :] if cosine(v[a], v[b]) >= 0.5}
    got = {(x["a"], x["b"]) for x in similar_pairs(df, lambda a, b: True, 0.5).collect()}
    assert got == want and want
    assert all(set(prefix(v[a], w, 0.5)) & set(prefix(v[b], w, 0.5)) for a, b in want)
    assert similar_pairs(df.limit(0), lambda a, b: True).count() == 0
    assert np.isfinite(w).all()
    letters = gram_weights(df.filter("block is not null and s is not null"), n=0)
    v = {s: weighted(s, letters, 0) for s in strings}
    cos = {(a, b): cosine(v[a], v[b]) for i, a in enumerate(strings) for b in strings[i + 1 :]}
    got = {(x["a"], x["b"]) for x in similar_pairs(df, lambda a, b: a[0] == b[0], 0.45, n=0, sure=0.8).collect()}
    assert got == {(a, b) for (a, b), c in cos.items() if c >= 0.8 or (c >= 0.45 and a[0] == b[0])}


def test_towns_with_exchanged_letters(spark):
    rows = [(1, "Institut Zorvan de Biologie, 12 rue Plimor, Belmora"), (2, "Institut Zorvan de Biologie, 12 rue Plimor, Belmroa"), (3, "Institut Zorvan de Biologie, 12 rue Plimor, Bolmira"), (4, "Institut Zorvan de Biologie, 12 rue Plimor, Belmira")]
    got = {(r["id_a"], r["id_b"]) for r in site_pairs(link_sites(spark.createDataFrame(rows, "id bigint, value string"), TOWNS, COUNTRIES)).collect()}
    assert got == {(1, 2), (1, 4), (2, 4)}


def test_large_blocks_meet_under_few_keys_and_lose_no_pair(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 7)))[: r.randint(3, 14)]
    base = [word() for _ in range(220)]
    near = set()
    for s in base:
        k = r.randrange(len(s) - 1)
        near |= {s[:k] + s[k + 1] + s[k] + s[k + 2 :], s[:k] + s[k + 1 :], s + "str", s + " raod", "ecloe " + s, s[:k] + "x" + s[k:] + "q", "z" + s[:k] + "v" + s[k + 1 :] + "w"}
    names = sorted({*base, *near})
    keys = {s: name_keys(s) for s in names}
    same = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if same_name(a, b)}
    assert len(same) > 500 and all(keys[a] & keys[b] for a, b in same)
    df = spark.createDataFrame([("k", s) for s in names], "block string, s string")
    got = [{(x["a"], x["b"]) for x in similar_pairs(df, same_name, 0.4, n=0, sure=SURE, near=name_keys, small=small).collect()} for small in (10_000, 2)]
    assert got[0] == got[1] and got[0]
    far = sorted({w for _ in range(1500) if len(w := word()) > 7})[:400]
    w = gram_weights(spark.createDataFrame([(s,) for s in far], "s string"), n=0)
    held = [set(index_keys(s, w, 0.4, 0, SURE, name_keys)) for s in far]
    met = sum(bool(a & b) for i, a in enumerate(held) for b in held[i + 1 :])
    old = [set(prefix(weighted(s, w, 0), w, 0.4)) for s in far]
    assert met < 0.25 * sum(bool(a & b) for i, a in enumerate(old) for b in old[i + 1 :])
