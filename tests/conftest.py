import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether two pandas frames have the same columns and the same rows in any order."""

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, bool | str):
            return str(v)
        return f"{v:.9g}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        rows = lambda f: sorted(tuple(plain(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
        assert rows(a) == rows(b)

    return check
