import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TESSELLA_TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints").config("spark.sql.warehouse.dir", f"{shared}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A connection per scale, with all tables as views."""
    made = {}

    def at(sf: str):
        if sf not in made:
            made[sf] = duckdb.connect()
            for t in TABLES:
                made[sf].sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
        return made[sf]

    return at


def plain(value):
    if isinstance(value, float):
        return round(value, 7)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def assert_same(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    mine = sorted((plain(tuple(r)) for r in df.select(*names).collect()), key=repr)
    theirs = sorted((plain(tuple(r[i] for i in at)) for r in relation.fetchall()), key=repr)
    assert mine == theirs
