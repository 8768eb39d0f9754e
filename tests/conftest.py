import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
sys.path.insert(0, ROOT)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    import tempfile

    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    return round(float(v), 9) if isinstance(v, float) or hasattr(v, "to_integral_value") else v


@pytest.fixture(scope="session")
def same_rows(duck):
    """Holds a DataFrame against SQL: columns, rows and values."""

    def check(df, sql):
        found = duck.sql(sql)
        columns = sorted(df.columns)
        assert sorted(found.columns) == columns
        place = [found.columns.index(c) for c in columns]
        expected = sorted((tuple(_plain(r[i]) for i in place) for r in found.fetchall()), key=repr)
        assert sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected

    return check
