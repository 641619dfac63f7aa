import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(pdf):
    """Rows of a frame in a comparable form, columns by name."""
    import math

    import numpy as np
    import pandas as pd

    def key(v):
        if isinstance(v, (list, np.ndarray)):
            return str([key(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, (bool, np.bool_)):
            return str(int(v))
        if isinstance(v, (int, float, np.number)):
            return f"{float(v) + 0.0:.8g}"
        return str(v)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(key, r)) for r in pdf[cols].itertuples(index=False))
