import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("QUIRE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    place = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(place / "shared"))
        .config("spark.sql.warehouse.dir", str(place / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def data():
    return DATA


def canonical(frame, columns):
    import pandas as pd

    def one(x):
        if hasattr(x, "tolist") and not isinstance(x, str):
            x = x.tolist()
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "NULL"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(one(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same_rows():
    def check(got, want):
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert canonical(got, columns) == canonical(want, columns)

    return check
