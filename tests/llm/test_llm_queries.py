import pytest

from docmill.llm.queries import QUERIES
from docmill.llm.sql import SQL
from tests.compare import assert_same, database

COLUMNS = {
    "p1_found": ["hit_id"], "p2_found": ["rtm_id_a", "rtm_id_b"], "p4_found": ["req_id", "attribute"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count() > 0
    if name in SQL:
        assert_same(df, database(data), SQL[name])
    else:
        assert df.count() > 0
