import numpy as np
import pytest

from corpusloom.llm.embed import TokenVectors, hyperplanes, signatures, skip_gram
from corpusloom.llm.matching import Record, Titles, compare, compare_numbers, match_references, number_marks, places
from corpusloom.llm.references import read_reference, read_work, surname_keys

GIVEN = frozenset(("anna", "bert"))
TITLE = "The narrow plasma and the early survey under the lattice Zorvin"


@pytest.mark.parametrize(
    "raw",
    [
        f"Kastelbrun, A., Ollmark, B. & Dimfor, C. (1998). {TITLE}. Annals of Plimor Optics, 12(3), 345-360.",
        f"Kastelbrun A, Ollmark B (1998) {TITLE}. Annal. Pli. Opt. 12:345",
        f"[17] {TITLE}. Annals of Plimor Optics 1998;12:345",
        f"KASTELBRUN A., OLLMARK B. - {TITLE}. Annals of Plimor Optics, 1998, t. 12, p. 345-360",
        f"A. Kastelbrun et al., {TITLE}, Annal. Pli. Opt. 12 (1998) 345–360.",
        f"{TITLE} / Anna Kastelbrun ; Bert Ollmark. Annals of Plimor Optics, 1998.",
        f"FROM CROSSREF > A. Kastelbrun and B. Ollmark, {TITLE}, Annal. Pli. Opt. 12 (1998) 345–360. doi:10.99001/ab. 1998.0001",
        f"Kastelbrun et al. [1998]. {TITLE}. Annals of Plimor Optics.",
    ],
)
def test_styles(raw):
    names, title, stems, years, nums, doi = read_reference(raw, None, GIVEN)
    assert title == TITLE.lower() and 1998 in years and stems.split()[:1] in (["ann"], []) and (not names or names[0] == "kastelbrun")
    assert "doi" not in raw or doi == "10.99001/ab.1998.0001"


def test_reference_without_title_and_without_anything():
    names, title, _, years, nums, _ = read_reference("A. Kastelbrun, B. Ollmark, Annal. Pli. Opt. 12, 345 (1998)", "Kastelbrun, Anna", GIVEN)
    assert names == ["kastelbrun", "ollmark"] and title == "" and {12, 345} <= set(nums) and years == [1998]
    assert read_reference(None, None, GIVEN) == ([], "", "", [], [], "") == read_reference("", " ", GIVEN)


def test_parts_of_works():
    assert surname_keys("de Kastel-Brun, Anna ; OLLMARK B. & al.", GIVEN) == ["kastelbrun", "ollmark"]
    assert read_work(["von Dorm", None], "RETRACTED: A <i>b</i> c", "1998", "Annals of X", "12", "345", "10.1/X")[1:] == ("a b c", "ann", [1998], [12, 345], "10.1/x")
    assert places(0, [1998], [12, 345]) == ["12:345"] and places(0, [], [-1, 3]) == [] and "12:345" in places(1, [1998], [12, 3, 345, 360])
    assert number_marks(np.array([1, 64, -1, 5]), np.array([3, 0, 1])).tolist() == [2, 0, 32]


def test_agreements():
    titles = Titles(lambda w: 1.0)
    pack = lambda names, title, stems="ann", doi="": Record("\x1f".join((names, title, stems, doi)))
    assert compare(pack("kastelbrun", "a b c d"), pack("kastelbrun ollmark", "a b c d"), titles) == (1.0, 1.0, 1.0, 1.0, -1.0, 1.0, 0.0)
    assert compare(pack("kastelbrum", "", ""), pack("kastelbrun", "a b"), titles) == (-1.0, 1.0, 1.0, -1.0, -1.0, -1.0, 0.0)
    years, nums = (np.array([1998, 1997]), np.array([1, 0, 1])), (np.array([1998, 12, 345, 7, 1997]), np.array([3, 1, 1]))
    got = compare_numbers(years, nums, np.array([1998, 1990, 1998]), np.array([12, 7, -1]), np.array([346, 8, 3]))
    assert [x.tolist() for x in got] == [[1.0, -1.0, 0.5], [1.0, 1.0, -1.0], [0.0, -1.0, -1.0]]


def test_vectors_keep_misspelt_tokens_near():
    v = TokenVectors({})
    a, b, c = v.of(["kastelbrunner", "kastelbruner", "ollmark"])
    assert a @ b > 0.75 > 0.5 > abs(a @ c)
    s = signatures(np.stack([a, a, c]), hyperplanes(2, 20), 2, 20)
    assert (s[0] == s[1]).all() and (s[0] != s[2]).any()


def test_walks_bring_tokens_of_one_record_together():
    trained = skip_gram([[("t", f"w{k % 5}"), ("t", f"x{k % 5}"), ("a", f"n{k % 5}")] for k in range(200)], epochs=6)
    near, far = [trained[x].astype(float) for x in ("w1", "n1")], trained["x3"].astype(float)
    assert near[0] @ near[1] > near[0] @ far
    assert skip_gram([]) == {}


def test_matching(spark):
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("abdegiklmnorstuvz")) for _ in range(8))
    works, refs, want = [], [], set()
    for k in range(60):
        name, title, vol, page, year = word().title(), " ".join(word() for _ in range(6)), int(r.integers(1, 200)), int(r.integers(1, 2000)), int(r.integers(1980, 2020))
        works.append((k, f"10.9/{k}", title, [("Anna", name)], str(year), "Annals of Zed", "Ann. Zed", str(vol), str(page)))
        refs.append((1000 + k, f"{name}, A. ({year}). {title}. Annals of Zed, {vol}(2), {page}-{page + 9}.", name))
        want.add((k, 1000 + k))
        t = title.split()
        t[2] = t[2][:3] + t[2][4:]
        refs.append((2000 + k, f"{name} A ({year}) {' '.join(t)}. Ann. Zed. {vol}:{page}", None))
        want.add((k, 2000 + k))
        refs.append((3000 + k, f"{word().title()}, A. (1999). {' '.join(word() for _ in range(6))}. Annals of Zed, 3(2), 17-19.", None))
    refs += [(9001, None, None), (9002, "", ""), (9003, "in preparation", "n/a"), refs[0]]
    w = spark.createDataFrame([*works, works[0], (999, "10.9/x", None, None, None, None, None, None, "1")], "work_id bigint, doi string, title string, author array<struct<given:string,family:string>>, issued string, source_long string, source_short string, volume string, first_page string")
    df = spark.createDataFrame([(*x, "clash") for x in refs], "ref_id bigint, raw_ref string, author string, score string")
    got = match_references(w, df)
    rows = got.collect()
    assert {(x["work_id"], x["ref_id"]) for x in rows} == want and len(rows) == len(want)
    assert all(0 <= x["confidence"] <= 1 for x in rows)
    assert match_references(w, df.limit(0)).count() == 0 and match_references(w.limit(0), df).count() == 0
    from corpusloom.llm.matching import candidates, fit_model, read_records

    records = read_records(w, df)
    model = fit_model(records)
    pairs = [sorted(map(tuple, candidates(records, model, hot).collect())) for hot in (2000, 1)]  # no crowded bucket, then many
    assert pairs[0] == pairs[1] and pairs[0]

    rows = [sorted(map(str, read_records(w, df, most).collect())) for most in (1000, 0)]  # known names broadcast, then joined
    assert rows[0] == rows[1]


def test_token_vectors_come_from_all_records(spark):
    from corpusloom.llm.matching import fit_model

    # far more records than were once drawn, each word in few of them
    rows = [(k, k % 2, f"n{k // 4}", f"w{k // 4} x{k // 4} z{k // 4}", "ann", [1990 + k % 20]) for k in range(9000)]
    records = spark.createDataFrame(rows, "id bigint, side int, names string, title string, stems string, years array<int>")
    trained = fit_model(records).trained
    got = [[trained.get(t) for t in (f"n{k}", f"w{k}", f"x{k + 700}")] for k in range(0, 1500, 10)]
    assert all(v is not None and np.linalg.norm(v.astype(float)) > 0.9 for row in got for v in row)
    near, far = (np.mean([row[0].astype(float) @ row[k].astype(float) for row in got]) for k in (1, 2))
    assert near > 0.2 + far


def test_hashed_tokens_are_made_once_with_the_records(spark):
    from corpusloom.llm.matching import _context, _contexts, read_records, walk_vectors

    kinds = "work_id bigint, doi string, title string, author array<struct<given:string,family:string>>, issued string, source_long string, source_short string, volume string, first_page string"
    works = [(1, None, "A b, a Été", [("Anna", "Kastel-Brun"), (None, None)], "1998", "Annals of Zed", None, "12", "3"), (2, None, None, None, None, None, None, None, None)]
    refs = [(7, "Kastelbrun A, Ollmark B (1998) Été of the lattice. Ann. Zed. 12:345", "Ollmark, B."), (8, None, None)]
    records = read_records(spark.createDataFrame(works, kinds), spark.createDataFrame(refs, "ref_id bigint, raw_ref string, author string"))
    rows = records.select("*", _contexts().alias("again")).collect()
    for r in rows:
        want = [*r["names"].split(), *r["title"].split(), *("s:" + x for x in r["stems"].split()), *(f"y:{y}" for y in r["years"])]
        assert r["tokens"] == [_context(t) for t in want] == (r["again"] or [])
    assert len(rows) == 4 and sum(not r["tokens"] for r in rows) == 2
    assert (walk_vectors(records) == walk_vectors(records.drop("tokens"))).all()


def test_sums_around_tokens_against_loops():
    from corpusloom.llm.embed import GATHERED, Contexts, TokenVectors, around

    r = np.random.default_rng(3)
    size = np.array([0, 1, 2, 0, *r.integers(1, 9, 1500)])
    ids, table = r.integers(0, 40, size.sum()).astype(np.int16), r.standard_normal((50, 6)).astype(np.float32)
    assert len(ids) > GATHERED
    want, at = np.zeros((50, 6)), 0
    for n in size:
        own = ids[at : at + n]
        for k, t in enumerate(own):
            want[t] += np.delete(table[own], k, axis=0).sum(0) / max(1, n - 1)
        at += n
    sums, met = around(ids, size, table)
    assert np.allclose(sums, want, atol=1e-2) and met.tolist() == np.bincount(ids, minlength=50).tolist()
    tokens, rows = ["ab", "cde", "ab"], r.standard_normal((4, 48)).astype(np.float16)
    at_once = TokenVectors(Contexts(rows, len))
    assert (at_once.of(tokens) == TokenVectors({t: at_once.trained.get(t) for t in tokens}).of(tokens)).all()
