"""Every query with SQL returns what DuckDB returns for it."""

import pytest

from simloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_matches_sql(spark, sf_dir, duck, same, name):
    query, sql = QUERIES[name]
    same(query(spark, sf_dir).toArrow(), duck.sql(sql).to_arrow_table())


@pytest.mark.parametrize("name", ["f9_search_segments_exact", "f8_search_segments_approx", "f3_search_prefix", "search_similarity"])
def test_ranks_do_not_follow_the_plan(spark, duck, same, name):
    """Equal scores part in their last bits only where sums follow the order of rows: another partitioning, and more data."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    query, sql = QUERIES[name]
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = connection.sql(sql).to_arrow_table()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (3, 7, 16):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            same(query(spark, folder).toArrow(), want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
