import pytest

from lorebase.llm.queries import ORACLES, QUERIES
from tests.oracles import rows, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    df = QUERIES[name](spark, folder).toPandas()
    columns, want = sql_rows(ORACLES[name], folder)
    assert sorted(df.columns) == columns and rows(df) == want


@pytest.mark.parametrize("name,columns", [("p1_found", ["src", "field", "record_key", "kind"]), ("p2_found", ["session_id", "pos", "event_id"]), ("p3_found", ["src", "tag_a", "tag_b"]), ("p4_found", ["path_a", "path_b"]), ("p5_found", ["src", "item_key"]), ("p6_ids", ["doc_id", "ids"]), ("p8_found", ["doc_id"])])
def test_columns_and_no_row_twice(spark, folder, name, columns):
    df = QUERIES[name](spark, folder)
    assert df.columns == columns
    n = df.count()
    assert n == df.distinct().count() and n > 0
