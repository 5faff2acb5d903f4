import random

import pytest

from corpusloom.llm.tokenize import BYTE_BPE_50K, PrefixEncoder, TextEncoding, count_tokens, encode_texts

TEXTS = ["", " ", None, "Hello world", "l'été\n\n  1234 don't", "<|endoftext|>", "é 日本語 😀🔬", "a" * 3000, "\t\r\n x  ", "ﬁ ² Ⅳ ١٢"]


@pytest.fixture(scope="module")
def encoder():
    with open(BYTE_BPE_50K, "rb") as f:
        return PrefixEncoder.from_bytes(f.read())


def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_library(encoder, spark, sf):
    texts = [t or "" for t in TEXTS] + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode(t) for t in texts] == want


def test_appends_and_edits_are_exact(encoder):
    r = random.Random(3)
    for _ in range(40):
        text = "".join(r.choice("ab é's 12\n.x") for _ in range(r.randint(0, 60)))
        e = TextEncoding(encoder, text)
        for _ in range(8):
            a = r.randint(0, len(e.text))
            e.edit(a, min(len(e.text), a + r.randint(0, 4)), r.choice(["", "x", " ", "'s", "\n ", "é1"]))
            assert e.ids() == encoder.encode(e.text)
        e.append(" and more")
        assert e.ids() == encoder.encode(e.text)


def test_an_append_encodes_only_what_is_new(encoder):
    e = TextEncoding(encoder, "word " * 2000)
    before = e.encoded
    e.append("tail")
    assert e.encoded - before < 60


def test_column(spark):
    rows = spark.createDataFrame([(k, t, "z") for k, t in enumerate(TEXTS)] + [(0, "", "z")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_texts(rows).collect()}
    assert got[0] == [] and got[2] == [] and got[1] == [220] and len(got) == len(TEXTS)
    n = {r["doc_id"]: r["n_tokens"] for r in count_tokens(rows, ["doc_id"]).collect()}
    assert all(n[k] == len(got[k]) for k in got)
    assert encode_texts(rows.limit(0)).count() == 0
