import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return tuple(normal(v) for v in value) if isinstance(value, list | tuple) else value


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame and SQL give the same rows under the same names."""

    def check(frame, sql):
        names = sorted(frame.columns)
        got = sorted((tuple(normal(r[n]) for n in names) for r in frame.collect()), key=repr)
        relation = duck.execute(sql)
        columns = [c[0] for c in relation.description]
        assert sorted(columns) == names
        wanted = sorted((tuple(normal(r[columns.index(n)]) for n in names) for r in relation.fetchall()), key=repr)
        assert got == wanted

    return check
