"""Grouping queries on tables in which one key holds a third of the rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import QUERIES, SF_DIR, SQL, TABLES, table

# Table -> (column, its hot value, key columns that tell rows apart).
HOT = {
    "events": ("user_id", 0, ["event_id"]),
    "orders": ("o_custkey", 0, ["o_orderkey"]),
    "lineitem": ("l_partkey", 0, ["l_orderkey", "l_linenumber", "l_quantity"]),
    "documents": ("source", "src0", ["doc_id"]),
    "embeddings": ("label", 0, ["vec_id"]),
    "customer": ("c_nationkey", 0, ["c_custkey"]),
    "supplier": ("s_nationkey", 0, ["s_suppkey"]),
}
GROUPING = [
    "alert_weekly_digest", "alert_daily_summary", "alert_low_logging", "dash_suggestions", "dash_consistency_matrix",
    "plan_first_pick", "remaining_kcal", "signup_validate", "signup_accept", "cap_per_group", "cap_per_group_exact",
    "incremental_not_in", "incremental_append", "recommend_batch", "recommend_no_match", "render_recipe_cards",
    "vector_topk_per_condition", "build_context", "upsert_replace_document", "facility_early_stop",
    "facility_text_search", "facility_radius", "facility_with_fallback", "render_report", "news_latest", "chunk_documents",
    "stream_daily_summary",
]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        rows = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        if name in HOT:
            column, value, keys = HOT[name]
            third = F.pmod(F.xxhash64(*keys), F.lit(3)) == 0
            kind = dict(rows.dtypes)[column]
            rows = rows.withColumn(column, F.when(third, F.lit(value)).otherwise(F.col(column)).cast(kind))
        rows.repartition(5).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", GROUPING)
def test_query_equals_sql_on_skewed_tables(spark, skewed, name):
    folder, con = skewed
    frame = QUERIES[name](spark, folder)
    cursor = con.execute(SQL[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == expected


LOOKUPS = [
    "recommend_batch", "recommend_no_match", "render_recipe_cards", "vector_topk_per_condition", "build_context",
    "upsert_latest", "upsert_replace_document", "facility_text_search", "facility_with_fallback",
]


@pytest.mark.parametrize("name", LOOKUPS)
def test_lookups_without_broadcast_equal_sql(spark, skewed, name):
    """The same with no table small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_query_equals_sql_on_skewed_tables(spark, skewed, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
