import random

from corpusloom.llm.repetition import Cascade, find_repetitive, measure_repetition, repeated_words, rules, words_of


def brute(words, n):
    covered = set()
    for i in range(len(words) - n + 1):
        if any(words[j : j + n] == words[i : i + n] for j in range(i)):
            covered.update(range(i, i + n))
    return len(covered)


def test_measure_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        w = [r.choice("abcde") for _ in range(r.randint(0, 40))]
        assert repeated_words(w, 5) == brute(w, 5)


def test_rules_never_reject_a_repetitive_text():
    r = random.Random(2)
    for _ in range(500):
        w = [r.choice("abcdefghij") for _ in range(r.randint(0, 60))]
        if w and r.random() < 0.6:
            at = r.randrange(len(w))
            w += w[at : at + r.randint(3, 12)]
        for share in (0.1, 0.25, 0.5):
            if w and brute(w, 5) >= share * len(w):
                assert not any(rule(w) for rule in rules(share, 5).values())


def test_order_does_not_change_the_outcome():
    r = random.Random(4)
    texts = [[r.choice("abcdefgh") for _ in range(r.randint(0, 50))] for _ in range(400)]
    short, long = Cascade(0.25, 5, sample=1), Cascade(0.25, 5, sample=10_000)
    assert [short.decide(t)[0] for t in texts] == [long.decide(t)[0] for t in texts]


def test_words():
    assert words_of("Été Été 2x-Y_z") == ["été", "été", "x", "y", "z"]
    assert words_of(None) == words_of("") == words_of(" 12 ") == []


def test_column(spark):
    twice = "one two three four five six seven. "
    rows = spark.createDataFrame([(1, twice * 2, 0), (1, twice * 2, 0), (2, twice, 0), (3, None, 0), (4, "", 0), (5, " 1 2 3 ", 0), (6, twice * 20_000, 0)], "doc_id int, text string, share int")
    assert sorted(r["doc_id"] for r in find_repetitive(rows).collect()) == [1, 6]
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"]) for r in measure_repetition(rows).collect()}
    assert got[1] == (14, 7) and got[2] == (7, 0) and got[3] == got[4] == got[5] == (0, 0)
    assert find_repetitive(rows.limit(0)).count() == 0


def test_units(spark):
    from corpusloom.llm.repetition import measure_units

    df = spark.createDataFrame([(1, "One two. one  TWO! Three\nOne two. one two! three"), (2, None), (3, ""), (4, "... 12 !")], "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in measure_units(df).collect()}
    assert got == {1: (6, 4, 2, 1), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0)}
