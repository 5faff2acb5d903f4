import pytest

from corpusloom.llm import queries as Q
from tests.oracle import assert_same, connect

WANT = {
    "p1_found": {"work_id", "ref_id"}, "p2_found": {"profile_id_a", "profile_id_b"}, "p3_found": {"id_a", "id_b"}, "p4_found": {"mention_id", "geonameid"},
    "p5_found": {"id", "seg", "lang"}, "p6_ids": {"doc_id", "ids"}, "p8_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    assert set(df.columns) == WANT.get(name, set(df.columns))
    got = df.toPandas()
    assert len(got) > 0
    if name != "p6_ids":
        assert not got.astype(str).duplicated().any()
    if name in Q.oracle_sql():
        assert_same(got, connect(sf).execute(Q.oracle_sql()[name]).df())
