import random

from corpusloom.llm.names import NameReader, close_pairs, faults, given_names, index_keys, left_keys, link_profiles, lookup_keys, one_apart, profile_pairs, read_profiles, same_given, variant_pairs
from corpusloom.llm.text import with_swaps
from tests.llm.test_canonical import plain_distance


def pool(n, seed):
    r = random.Random(seed)
    out = set()
    for _ in range(n):
        w = "".join(r.choice("abcdr") for _ in range(r.randint(1, 13)))
        out.add(w)
        k = r.randrange(len(w))
        out.add(w[:k] + r.choice("abx") + w[k + 1 :])
        out.add(w[:k] + w[k + 1 :])
    return sorted(out - {""})


def test_segment_join_against_brute_force(spark):
    names = pool(120, 1)
    got = {(r["a"], r["b"], r["faults"]) for r in variant_pairs(spark.createDataFrame([(n,) for n in [*names, *names[:9]]] + [(None,), ("",)], "s string")).collect()}
    want = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            s, t = sorted((a, b), key=lambda x: (len(x), x))
            d = plain_distance(s, t)
            if d <= faults(len(s)):
                want.add((s, t, d))
    assert got == want
    assert variant_pairs(spark.createDataFrame([], "s string")).count() == 0


def test_every_pair_within_the_faults_shares_a_key():
    r = random.Random(5)
    for _ in range(500):
        s = "".join(r.choice("abc") for _ in range(r.randint(5, 20)))
        t = list(s)
        for _ in range(faults(len(s))):
            t.insert(r.randrange(len(t) + 1), r.choice("abc"))
        assert set(index_keys(s)) & set(lookup_keys("".join(t)))


def test_short_names_meet_under_few_keys_and_lose_no_pair():
    r = random.Random(6)
    for n in range(5, 16):
        s = "".join(r.choice("abc") for _ in range(n))
        for _ in range(40):
            t = list(s)
            for _ in range(faults(n)):
                k, what = r.randrange(len(t)), r.random()
                t[k : k + (what > 0.3)] = [r.choice("abd")] if what < 0.8 or len(t) < n else []
            if len(t) >= n:
                which, keys = left_keys([s, "".join(t)])
                assert set(keys[which == 0]) & set(keys[which == 1]), (s, t)
    names = sorted({"".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(700)})
    which, keys = left_keys(names)
    by_key, met = {}, set()
    for i, k in zip(which.tolist(), keys.tolist()):
        met |= {(j, i) for j in by_key.get(k, ()) if j != i}
        by_key.setdefault(k, set()).add(i)
    held, old = [set(index_keys(s)) for s in names], 0
    for k, s in enumerate(names):
        look = set(lookup_keys(s))
        old += sum(bool(look & h) for h in held[:k])
    assert len(met) < 0.1 * old


def test_given_names():
    assert same_given(["anna"], ["anna"]) == 3 and same_given(["bob"], ["robert"]) == 2 and same_given(["a"], ["anna"]) == 1
    assert same_given(["anna"], ["bert"]) == 0 and same_given(["j", "p"], ["jean", "luc"]) == 0 and same_given(["jean-paul"], ["jean paul"]) == 3
    assert same_given([], ["anna"]) == 1 and same_given(["marie"], ["marie-claire"]) == 1 and same_given(["anan"], ["anna"]) == 2


def test_reader():
    r = NameReader({"anna": 3.0, "jean": 3.0, "paul": 3.0})
    assert r.read("Anna", "van Dorm") == (["anna"], "dorm") == r.read("van Dorm", "Anna") == r.read(None, "van Dorm, Anna") == r.read("Anna van Dorm", None)
    assert r.split("DORM Anna")[1] == r.split("Dorm, A.")[1] == r.split("A. Dorm")[1] == "dorm"
    assert r.read(None, None) == ([], "") and r.read("n/a", " ") == ([], "")


COLS = "profile_id bigint, id bigint, firstName string, lastName string, email array<string>, affiliations array<string>, titles array<string>, coAuthors array<string>, person string"


def profiles(spark):
    a, b = ["Institut Zorvan de Biologie"], ["Centre Plimor de Physique"]
    rows = [
        (1, 1, "Anna", "Kastelbrun", ["a@x.org"], a, None, ["Bert Ollmark", "C. Dimfor"]), (2, 2, "Anna", "Kastelburn", None, a, None, None), (3, 3, "A.", "Kastelbrun", ["A@X.ORG"], None, None, []),
        (4, 4, "Kastelbrun", "Anna", None, None, None, ["Ollmark B", "Dimfor, Carl"]),
        (5, 5, "Anna", "Kastelbrun", None, b, None, ["Eve Quandor", "Finn Rast"]), (6, 6, "Anna", "Kastelbrun", None, b, None, ["Finn Rast", "Eve Quandor"]),
        (7, 7, "Otto", "Kastelbrun", None, a, None, ["Bert Ollmark"]), (8, 8, None, None, None, None, None, None), (9, 9, None, None, None, None, None, None),
        (10, 10, "Greta", "Wolmarin", None, a, None, None), (11, 11, "Greta", "Wolmarin", None, None, None, None),
    ]
    more = [(100 + k, k, f"Anna{'' if k % 3 else ' B.'}", f"Person{chr(97 + k % 26)}{chr(97 + k // 26)}son", None, None, None, ["Anna Kastelbrun"]) for k in range(12)]
    return spark.createDataFrame([(*r, "clash") for r in [*rows, rows[0], *more]], COLS)


def test_linking(spark):
    got = {(r["profile_id_a"], r["profile_id_b"]) for r in profile_pairs(link_profiles(profiles(spark))).collect()}
    small = {p for p in got if p[1] < 100}
    assert small == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6), (10, 11)}


def test_empty(spark):
    assert link_profiles(profiles(spark).limit(0)).count() == 0


def test_rare_spellings_are_linked_by_shared_evidence(spark):
    rows = [
        (1, 1, "Anna", "Droltavulm", ["a@x.org"], None, None, None), (2, 2, "Anna", "Droltawulm", ["A@x.org"], None, None, None),
        (3, 3, "Bert", "Quimsander", None, ["Institut Zorvan"], None, None), (4, 4, "Bert", "Quimsanter", None, ["Institut Zorvan"], None, None), (5, 5, "Bert", "Quimsanter", None, ["Institut Zorvan"], None, None),
        (6, 6, "Carl", "Wolmarinth", None, None, ["Stone walls in rivers"], None), (7, 7, "Carl", "Wolmarintz", None, None, ["Stone walls in rivers"], None),
        (8, 8, "Dora", "Droltawulm", ["a@x.org"], None, None, None),
    ]
    got = {(r["profile_id_a"], r["profile_id_b"]) for r in profile_pairs(link_profiles(spark.createDataFrame([(*r, "clash") for r in rows], COLS))).collect()}
    assert got == {(1, 2), (3, 4), (3, 5), (4, 5)}


def test_close_pairs_against_brute_force(spark):
    names = sorted({*pool(120, 3), "quoug", "quogu", "demi", "demmi"})
    got = {(r["a"], r["b"]) for r in close_pairs(spark.createDataFrame([(n,) for n in [*names, *names[:9], "", None]], "s string")).collect()}
    ordered = sorted(names, key=lambda x: (len(x), x))
    assert got == {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if 3 <= len(a) <= 7 and with_swaps(a, b) <= 1}
    assert {("quogu", "quoug"), ("demi", "demmi")} <= got


def test_short_and_exchanged_spellings_are_linked_by_shared_evidence(spark):
    rows = [
        (1, 1, "Anna", "Quoug", ["a@x.org"], None, None, None), (2, 2, "Anna", "Quogu", ["A@x.org"], None, None, None), (3, 3, "Bert", "Demi", None, ["Institut Zorvan"], None, None),
        (4, 4, "Bert", "Demmi", None, ["Institut Zorvan"], None, None), (5, 5, "Bert", "Demmo", None, None, ["Stone walls in rivers"], None), (6, 6, "Carl", "Demi", None, ["Institut Zorvan"], None, None),
        (7, 7, "Dora", "Jisu", None, None, ["Stone walls in rivers"], None), (8, 8, "Dora", "Jiesu", None, None, ["Stone walls in rivers"], None),
    ]
    got = {(r["profile_id_a"], r["profile_id_b"]) for r in profile_pairs(link_profiles(spark.createDataFrame([(*r, "clash") for r in rows], COLS))).collect()}
    assert got == {(1, 2), (3, 4)}


def test_one_apart():
    r = random.Random(3)
    for _ in range(3000):
        a, b = sorted(("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(2)), key=len)
        assert one_apart(a, b) == (with_swaps(a, b) <= 1), (a, b)


def test_known_names_by_join_and_broadcast(spark):
    rows = [(1, "Anna Maria", "Kastelbrun", ["Bert Ollmark"]), (2, "Kastelbrun", "Anna", ["Ollmark, Bert"]), (3, None, "Bert Ollmark", None), (4, "Bert", "Dimfor", []), (5, "Bert", "Zorv", None), (6, "Bert", "Plim", None), (7, "Anna", "Zorv", None), (8, "Anna", "Plim", None)]
    df = spark.createDataFrame([(i, f, n, None, None, None, c) for i, f, n, c in rows], "profile_id bigint, firstName string, lastName string, email array<string>, affiliations array<string>, titles array<string>, coAuthors array<string>")
    got = [sorted(map(str, read_profiles(df, given_names(df), most).collect())) for most in (1000, 0)]
    assert got[0] == got[1]


def test_profiles_without_evidence(spark):
    rows = [(1, "Anna", "Kastelbrun"), (2, "Anna", "Kastelbrun"), (3, "Bert", "Ollmark"), (4, "Bert", "Ollmark"), (5, "Bert", "Ollmark"), (6, "B.", "Dimfor"), (7, "Bert", "Dimfor")]
    df = spark.createDataFrame([(i, f, n, None, None, None, None) for i, f, n in rows], "profile_id bigint, firstName string, lastName string, email array<string>, affiliations array<string>, titles array<string>, coAuthors array<string>")
    got = {(x["profile_id_a"], x["profile_id_b"]) for x in profile_pairs(link_profiles(df)).collect()}
    assert got == {(1, 2), (6, 7)}
