import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
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
    return SF


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return db


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL, whatever the order of rows."""

    def rows(columns, found):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        text = lambda x: repr(float(x)) if isinstance(x, float) else repr(x)
        return sorted(tuple(text(r[i]) for i in order) for r in found)

    def check(query, sql):
        df = query(spark, SF)
        found = rows(df.columns, df.collect())
        cursor = duck.execute(sql)
        columns = [d[0] for d in cursor.description]
        wanted = rows(columns, cursor.fetchall())
        assert sorted(columns) == sorted(df.columns)
        assert found == wanted

    return check
