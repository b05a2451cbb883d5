"""A local session for all tests; tables come from the driver's smallest folder."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.sql(f"create view {file.split('.')[0]} as select * from '{sf_dir}/{file}'")
    return connection


@pytest.fixture(scope="session")
def same():
    def normal(table, columns):
        return sorted(str(tuple(row[c] for c in columns)) for row in table.select(columns).to_pylist())

    def compare(ours, theirs):
        columns = sorted(ours.column_names)
        assert columns == sorted(theirs.column_names)
        assert normal(ours, columns) == normal(theirs, columns)

    return compare
