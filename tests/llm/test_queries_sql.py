import duckdb
import pytest

from larder.llm import queries
from tests.test_queries import SF_DIR, TABLES, table


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    cursor = con.execute(queries.SQL[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    frame = queries.QUERIES[name](spark, SF_DIR)
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == expected
